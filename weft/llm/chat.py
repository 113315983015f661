"""Chat formatting over a prefix tree of conversations.

Conversations that share initial turns share the path of those turns. Sorted by
their path, conversations stand in depth-first order, and what two neighbours
share is their common prefix; so one range sort builds the tree, and each task
emits its stretch by streaming, without gathering a subtree. A stretch is cut
into packs of bounded size; a pack holds every shared turn once, with

* the token ids, depth first,
* a position id for each token: its place in its own conversation,
* a mask of the tokens to learn from (assistant texts),
* for each turn its span, its parent, and the intervals of tokens of all its
  ancestors: a token attends to these and to its own turn up to itself,
* for each conversation its last turn in the pack.

Template: ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash
is doubled and ``<|`` becomes ``<\\|``, so no text can hold a control string; each
control string is one token id above the vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import vocab
from weft.session import shuffle_partitions

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKS = (TURN, TEXT, END)
LEARN = "assistant"
PACK_TOKENS = 8192
PACK_CONVERSATIONS = 2048
PACK = (
    "tokens array<int>, positions array<int>, learn array<boolean>, turn_start array<int>, turn_end array<int>, "
    "turn_parent array<int>, attend_start array<array<int>>, attend_end array<array<int>>, conv_id array<bigint>, conv_turn array<int>"
)
_FORM = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation in order; nulls are empty strings.

    Nothing says which rows without a ``conv_id`` belong together, so each is a conversation of its own.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ident = F.col("conv_id").cast("long")
    keyed = rows.select(ident.alias("conv_id"), F.when(ident.isNull(), F.monotonically_increasing_id()).alias("alone"), turn.alias("told"))
    return keyed.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("told")).alias("turns")).drop("alone")


class _Pack:
    def __init__(self) -> None:
        self.tokens: list[int] = []
        self.positions: list[int] = []
        self.learn: list[bool] = []
        self.spans: list[tuple[int, int, int]] = []
        self.attend: list[tuple[list[int], list[int]]] = []
        self.convs: list[tuple[int | None, int]] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv: int | None, turns: list[tuple[str, str]], encode: object, base: int) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        at = sum(self.spans[n][1] - self.spans[n][0] for _, n in self.path)
        for role, text in turns[shared:]:
            head, body = encode(escape(role)), encode(escape(text))
            ids = [base, *head, base + 1, *body, base + 2]
            parent = self.path[-1][1] if self.path else -1
            start = len(self.tokens)
            self.tokens += ids
            self.positions += range(at, at + len(ids))
            self.attend.append(_joined([self.spans[n] for _, n in self.path]))
            before = len(head) + 2
            self.learn += [False] * before + [role == LEARN] * len(body) + [False]
            at += len(ids)
            self.spans.append((start, len(self.tokens), parent))
            self.path.append(((role, text), len(self.spans) - 1))
        self.convs.append((conv, self.path[-1][1]))

    def row(self) -> tuple:
        starts, ends, parents = zip(*self.spans)
        attend = [[a for a, _ in self.attend], [b for _, b in self.attend]]
        return (self.tokens, self.positions, self.learn, list(starts), list(ends), list(parents), *attend, [c for c, _ in self.convs], [n for _, n in self.convs])


def _joined(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of ascending spans, neighbours joined."""
    starts, ends = [], []
    for a, b, _ in spans:
        if ends and ends[-1] == a:
            ends[-1] = b
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _batch(packs: list[_Pack]) -> pa.RecordBatch:
    ints, flags, longs = pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64())
    kinds = [ints, ints, flags, ints, ints, ints, pa.list_(ints), pa.list_(ints), longs, ints]
    cols = list(zip(*[p.row() for p in packs]))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PACK.split(", ")])


def pack(rows: DataFrame, ranks: str = vocab.RANKS, pack_tokens: int = PACK_TOKENS, pack_conversations: int = PACK_CONVERSATIONS) -> DataFrame:
    """Packs over all conversations of ``rows`` (``conv_id, turn, role, text``).

    A null role or text is empty; turns of one number follow by role and text, and
    repeated rows are repeated turns; a null turn comes first; a row with a null
    ``conv_id`` is a conversation of its own; one conversation longer than a pack
    is a pack of its own; an empty table gives no packs; other columns do not matter.
    """
    spark = rows.sparkSession
    shared = vocab.shared(spark, ranks)
    digest = F.transform("turns", lambda t: F.substring(F.sha2(F.concat_ws("\n", t["role"], t["text"]), 256), 1, 16))
    ordered = (
        conversations(rows)
        .withColumn("path", F.array_join(digest, ""))
        .repartitionByRange(shuffle_partitions(spark), "path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = vocab.encoding(shared.value)
        now, done = _Pack(), []
        for batch in batches:
            for conv, roles, texts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                now.add(conv, list(zip(roles, texts)), encoder.encode_ordinary, len(sizes))
                if len(now.tokens) >= pack_tokens or len(now.convs) >= pack_conversations:
                    done.append(now)
                    now = _Pack()
                if len(done) >= 16:
                    yield _batch(done)
                    done = []
        if now.convs:
            done.append(now)
        if done:
            yield _batch(done)

    return ordered.mapInArrow(run, PACK)


def ancestors(parents: list[int], turn: int) -> list[int]:
    """The turns from the first of the conversation to ``turn``."""
    out = []
    while turn >= 0:
        out.append(turn)
        turn = parents[turn]
    return out[::-1]


def read_back(packs: DataFrame, ranks: str = vocab.RANKS) -> DataFrame:
    """Each conversation as its pack's tokens say: digests of its turns and of what is learned.

    What its last turn attends to must be the conversation, token by token.
    Nulls were written as empty strings, so none come back.
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens``.
    """
    shared = vocab.shared(packs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = vocab.encoding(shared.value)
        words = [encoder.decode_single_token_bytes(i) for i in range(len(sizes))] + [m.encode() for m in MARKS]
        kind = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars n_tokens".split()
        for batch in batches:
            out = []
            tokens, positions, learn = (_lists(batch, name) for name in ("tokens", "positions", "learn"))
            rest = batch.select(["turn_start", "turn_end", "turn_parent", "attend_start", "attend_end", "conv_id", "conv_turn"])
            for ids, places, mask, p in zip(tokens, positions, learn, rest.to_pylist()):
                spell = lambda part: b"".join(map(words.__getitem__, part.tolist())).decode("utf-8")
                ends, reach, told, chars, loss = dict(zip(p["turn_start"], p["turn_end"])), [], [], [], []
                for a, b, parent in zip(p["turn_start"], p["turn_end"], p["turn_parent"]):
                    at = reach[parent] if parent >= 0 else 0
                    reach.append(at + b - a)
                    if (places[a:b] != np.arange(at, at + b - a)).any():
                        raise ValueError("positions do not go on from the turn before")
                    turn = spell(ids[a:b])
                    chars.append(len(turn))
                    told.append([f"{unescape(role)}\n{unescape(text)}\n" for role, text in _FORM.findall(turn)])
                    loss.append(unescape(spell(ids[a:b][mask[a:b]])))
                for conv, last in zip(p["conv_id"], p["conv_turn"]):
                    path = ancestors(p["turn_parent"], last)
                    span = [*zip(p["attend_start"][last], p["attend_end"][last]), (p["turn_start"][last], p["turn_end"][last])]
                    if [x for n in path for x in (p["turn_start"][n], p["turn_end"][n])] != _cuts(span, ends):
                        raise ValueError(f"conversation {conv} attends to other turns than its own")
                    turns = [t for n in path for t in told[n]]
                    learned = "".join(loss[n] for n in path)
                    out.append((conv, len(turns), _sha("".join(turns)), len(learned), _sha(learned), sum(chars[n] for n in path), reach[last]))
            cols = list(zip(*out)) if out else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=kind)

    return packs.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    )


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The lists of a column, as arrays."""
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return iter(np.split(flat, np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else [])


def _cuts(span: list[tuple[int, int]], ends: dict[int, int]) -> list[int]:
    """Starts and ends of the turns that ``span`` covers, as far as it covers whole ones."""
    out = []
    for a, b in span:
        while a < b:
            if a not in ends:
                return out
            out += [a, ends[a]]
            a = ends[a]
    return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
