"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the ``k`` least distinct 64-bit shingle hashes
of a text. The sketch of a union is the ``k`` least of both sketches, so parts
of a text or of a corpus can be sketched apart and merged. From two sketches
come estimates of resemblance, containment and distinct shingle counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.text import GAPS
from weft.session import shuffle_partitions

K = 128
SHINGLE = 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all shingles; fewer words than ``shingle`` make one, none none."""
    marks = F.transform(words(text), lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        last = F.size(h) - shingle
        many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(many)

    # binding through a one-element array keeps the word hashes from being evaluated twice
    return F.get(F.transform(F.array(marks), grams), F.lit(0))


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, shingle))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what ``a`` and ``b`` were made from."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; two empty sketches are alike (1), one empty is not (0)."""
    return _rate(merge(a, b, k), F.array_intersect(a, b))


def _rate(union: Column, both: Column) -> Column:
    share = F.size(F.array_intersect(union, both)) / F.size(union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(share.cast("double"))


def containment(a: Column, b: Column, like: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, from their resemblance ``like``; an empty ``a`` gives 1."""
    na, nb = distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), like * (na + nb) / ((1 + like) * na)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below ``k``, else by the k-th least hash."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def text_form(a: Column) -> Column:
    """A printable form of a sketch (base 64 of its hashes)."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def corpus_sketch(docs: DataFrame, by: list[str], k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """One merged sketch for each group of ``by``, e.g. a source.

    The hashes of each document's own sketch are enough: what is among the
    ``k`` least of a group is among the ``k`` least of a document. Two distinct
    passes and a bounded top-k by salt keep a hot group in small parts.
    """
    salt = F.pmod(F.col("_h"), F.lit(64))
    hashes = docs.select(*by, F.explode(sketch(F.col("text"), k, shingle)).alias("_h")).distinct().withColumn("_s", salt)
    part = W.partitionBy(*by, "_s").orderBy("_h")
    whole = W.partitionBy(*by).orderBy("_h")
    few = hashes.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    least = few.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))


def _bucket(bounds: list[float], value: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, by a search in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not rows:
        return F.lit(0)
    tops = F.array(*[F.lit(r[-1]) for r in rows])
    lists = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    full = F.size(F.filter(tops, lambda x: x < value))
    rest = F.size(F.filter(F.coalesce(F.get(lists, full), F.array().cast("array<double>")), lambda x: x < value))
    return full * step + rest


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows ``(doc_id, text)`` in buckets of neighbouring ids, ready for ``lead``.

    Buckets are cut at quantiles of ``doc_id``, so any spread of ids gives even
    buckets; equal ids share one. The first row of each bucket is also a guest
    at the end of the bucket before it (of the last bucket, for the very first),
    where it serves as a next row only. The table of first rows has one entry
    a bucket, whatever the input.
    """
    ident = F.col("doc_id").cast("double")
    probs = [i / parts for i in range(1, parts)]
    cuts = docs.select(ident.alias("d")).approxQuantile("d", probs, 0.25 / parts) if probs else []
    tagged = docs.withColumn("bucket", F.coalesce(_bucket(sorted(set(cuts)), ident), F.lit(0))).withColumn("h", F.xxhash64("text"))
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "h")
    heads = sorted((r["bucket"], r["m"]["d"], r["m"]["h"]) for r in tagged.groupBy("bucket").agg(F.min(place).alias("m")).collect())
    hosts = [(d, h, heads[i - 1][0]) for i, (_, d, h) in enumerate(heads)]
    guests = docs.sparkSession.createDataFrame(hosts, "gd long, gh long, host int")
    key = (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("gd")) & (F.col("h") == F.col("gh"))
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest"))
    also = F.struct(F.col("host").alias("b"), F.lit(True).alias("guest"))
    seats = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, also))
    return (
        tagged.join(F.broadcast(guests), key, "left")
        .select("doc_id", "text", "h", F.explode(seats).alias("seat"))
        .select("doc_id", "text", "h", F.col("seat.b").alias("bucket"), F.col("seat.guest").alias("guest"))
    )


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of each text, of its edited text, and how alike they are.

    The edited text has its last quarter of code points replaced by as many
    first ones of the next document in ascending ``doc_id`` (after the last:
    the first). Columns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, containment, n_shingles``.

    Null texts are empty; equal texts have equal sketches; rows of one
    ``doc_id`` follow each other by the hash of their text; a null ``doc_id``
    comes first; a lone document is its own next; an empty table gives no rows;
    other columns do not matter. Texts are shuffled once, by buckets of ids.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "h")
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), F.length("text") - quarter), F.col("next_text").substr(F.lit(1), quarter)
    )
    return (
        with_next(slim, 4 * parts)
        .repartition(parts, "bucket")
        .withColumn("own", sketch(F.col("text"), k, shingle))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_own", F.lead("own").over(order))
        .where("not guest")
        .withColumn("edited", edited)
        .withColumn("edited_own", sketch(F.col("edited"), k, shingle))
        .withColumn("all_edited", merge(F.col("own"), F.col("edited_own"), k))
        .withColumn("all_next", merge(F.col("own"), F.col("next_own"), k))
        .withColumn("near_edited", _rate(F.col("all_edited"), F.array_intersect("own", "edited_own")))
        .select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited"), 256).alias("edited_sha256"),
            text_form(F.col("own")).alias("fingerprint"),
            text_form(F.col("edited_own")).alias("edited_fingerprint"),
            "near_edited",
            _rate(F.col("all_next"), F.array_intersect("own", "next_own")).alias("near_next"),
            containment(F.col("own"), F.col("edited_own"), F.col("near_edited"), k).alias("containment"),
            distinct_count(F.col("own"), k).alias("n_shingles"),
        )
    )
