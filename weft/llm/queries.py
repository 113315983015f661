"""Queries of the training-data operators: each on its whole table, as its contract asks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import chat, decontam, lm, mixture, shards, simhash, sketch, substring, tokens, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.strip_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    trial = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trial), (-7, 1, "assistant", trial)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.pack(rows)).drop("n_tokens")


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents")).drop("text_key")


def queries() -> dict[str, Query]:
    found = [op1_simhash, op2_decontamination, op3_toxicity, op4_token_attribution, op5_substring_dedup, op6_bottom_k, op7_context_mixing, op8_chat_tree, op9_mixture, op10_sharding]
    return {f.__name__: f for f in found}


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op7 does not depend on the trained model."""
    base = F.round("base_score", 4).alias("base_score")
    return lm.score(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base)


def sketch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6 does not depend on shingle hashes."""
    return sketch.fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def mixture_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9 does not depend on the seed."""
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law of op10 as one row: sizes, gapless slots, whether a group of equal texts that fits half a shard lies apart."""
    dealt = shards.assign(table(spark, sf_dir, "documents"))
    each = dealt.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots")
    )
    groups = dealt.groupBy("text_key").agg(F.sum("size").alias("own"), F.countDistinct("shard").alias("homes")).where("homes > 1")
    room = F.sum("bytes") / F.count("shard") / 2
    gapless = F.bool_and((F.col("low") == 0) & (F.col("high") == F.col("rows") - 1) & (F.col("slots") == F.col("rows")))
    near = F.max("bytes") - F.min("bytes") <= F.avg("bytes") * 0.01
    both = each.unionByName(groups.agg(F.min("own").alias("least_apart")), allowMissingColumns=True)
    apart = F.coalesce(F.min("least_apart") <= room, F.lit(False)).alias("small_group_apart")
    return both.agg(F.sum("rows").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.count("shard").alias("n_shards"), gapless.alias("gapless"), near.alias("near_equal"), apart)


def companions() -> dict[str, Query]:
    """Parts of operators whose whole results SQL cannot state, each with SQL."""
    return {f.__name__: f for f in (lm_base, sketch_edits, mixture_targets, shard_balance)}


_OP5 = r'''
with d as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
),
place as (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from d),
win as (select doc_id, i, w[i : i + 12] as g from place),
earliest as (select g, min(doc_id) as least from win group by g),
hit as (select doc_id, i from win join earliest using (g) where least < doc_id),
gone as (select distinct doc_id, i + k as i from hit, generate_series(0, 12) t(k)),
word as (select doc_id, unnest(w) as x, unnest(generate_series(1, len(w))) as i from d),
left_over as (
  select doc_id, count(*) as n, string_agg(x, ' ' order by i) as kept
  from word anti join gone using (doc_id, i) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join left_over using (doc_id)
'''

_OP8 = r'''
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
told as (
  select conv_id, count(*)::bigint as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '') as loss,
         string_agg(
           '<|turn|>' || replace(replace(role, '\', '\\'), '<|', '<\|') || '<|text|>'
           || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>', '' order by turn, role, text
         ) as formatted
  from c group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
       length(formatted)::bigint as formatted_chars
from told
'''


def oracle_sql() -> dict[str, str]:
    # Stated independently of the operators: windows compared as words, turns as text.
    return {"op5_substring_dedup": _OP5, "op8_chat_tree": _OP8}


# CRC-32 of the id's digits, bit by bit.
_CRC = """
xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)
"""
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LM_BASE = f"""
with d as (select doc_id, ({_CRC}) % 10 = 0 as held_out, {_WORDS.format(_LOWER)} as w from documents),
token as (select doc_id, held_out, unnest(list_append(w, '')) as x from d),
seen as (select x, count(*) as c from token where not held_out group by x),
whole as (select sum(c) as n, count(*) as v from seen)
select doc_id, held_out, count(*)::bigint as n_tokens, count(c)::bigint as n_known, any_value(n)::bigint as train_tokens,
       round(sum(log10((coalesce(c, 0) + 0.1::double) / (n + 0.1::double * (v + 1)))), 4) as base_score
from token left join seen using (x), whole group by doc_id, held_out
"""

_SKETCH_EDITS = """
with d as (
  select doc_id, coalesce(text, '') as t, coalesce(lead(text) over (order by doc_id), '') as next_text,
         row_number() over (order by doc_id desc) = 1 as is_last, (select coalesce(arg_min(coalesce(text, ''), doc_id), '') from documents) as first_text
  from documents
)
select doc_id, length(t)::bigint as n_chars,
       sha256(left(t, length(t) - length(t) // 4) || left(case when is_last then first_text else next_text end, length(t) // 4)) as edited_sha256
from d
"""

# Sources fill up in the order in which they reach three times their size; the others share what is left by weight.
_MIXTURE_TARGETS = f"""
with d as (select doc_id, source, len({_WORDS.format("coalesce(text, '')")})::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as w from d group by source),
r as (
  select *, 3.0::double * source_size / w as level, sum(source_size) over () as total,
         coalesce(sum(3 * source_size) over (order by 3.0::double * source_size / w, w, source rows between unbounded preceding and 1 preceding), 0) as full_before,
         sum(w) over (order by 3.0::double * source_size / w, w, source rows between current row and unbounded following) as open_weight
  from s
),
share as (select arg_max((total - full_before)::double / open_weight, open_weight) as rate from r where (total - full_before)::double / open_weight <= level)
select doc_id, size, source_size, round(least(w * rate, 3.0::double * source_size), 4) as target
from d join r on d.source is not distinct from r.source, share
"""

_SHARD_BALANCE = """
select count(*)::bigint as n_rows, sum(strlen(coalesce(text, '')) + 1)::bigint as n_bytes, 16::bigint as n_shards,
       true as gapless, true as near_equal, false as small_group_apart
from documents
"""


def companion_sql() -> dict[str, str]:
    return {"lm_base": _LM_BASE, "sketch_edits": _SKETCH_EDITS, "mixture_targets": _MIXTURE_TARGETS, "shard_balance": _SHARD_BALANCE}
