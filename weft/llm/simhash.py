"""Near-duplicate documents by SimHash and pivot distance tables.

A fingerprint is 64 majority bits over the XXH64 hashes of a text's word
shingles. Two fingerprints link if at most ``radius`` bits differ.

How the join stays sparse:

1. Equal fingerprints are one node, so copies never meet in pairs.
2. ``blocks`` slices of the 64 bits; fingerprints within ``radius`` bits agree
   on at least ``blocks - radius`` slices, so every such combination is a key
   that all linked pairs share at least once. The number of slices follows
   the number of distinct fingerprints, never the result.
3. A pivot table holds each fingerprint's Hamming distances to 21 reference
   fingerprints, packed seven to a long. By the triangle inequality a pair
   whose table rows differ by more than ``radius`` in any coordinate is
   discarded inside the join; survivors are verified by their exact distance
   and given out at the first key they share.
4. A key with more than ``hot`` fingerprints leaves the pair join: its members
   are dealt into blocks of bounded size, every two blocks meet in a task of
   their own, and the task returns a spanning forest of the links, never all
   pairs. Connectivity is exact either way. Inside a task rows are sorted by
   their distance to the first pivot, so only a window of them is looked at, and
   the other pivots discard before the exact distance verifies.

Distances of unrelated fingerprints gather tightly around 32 of 64, so pivot
coordinates alone separate too little to serve as join keys; that is why the
slices of step 2 bring candidates together and the pivots discard them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.neardup import keep_least
from weft.llm.text import within as _within
from weft.operators.components import connected_components
from weft.session import cut

_STEP = 32_768
_SALTS = 16
_LANES = 7


def simhash64(text: bytes | None, shingle: int = 4) -> int:
    """Majority bits of the shingle hashes as an unsigned integer.

    A-Z are lower-cased; fewer words than ``shingle`` make one shingle; no
    word at all (null, empty, white space) gives 0. A tie leaves the bit 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    ends = stops[min(shingle, len(words)) - 1 :].tolist()
    starts = np.concatenate(([0], stops[: n - 1] + 1)).tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _STEP):
        raw = b"".join([digest(joined[i:j], 42) for i, j in zip(starts[at : at + _STEP], ends[at : at + _STEP])])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprint_batches(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((simhash64(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(marks.view(np.int64))], names=["doc_id", "text_key", "fp"]
        )


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, text_key, fp)`` per row of ``docs``; other columns are ignored."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.col("text").cast("binary").alias("text"),
    )
    return slim.mapInArrow(partial(_fingerprint_batches, shingle), "doc_id long, text_key long, fp long")


def pivots(count: int = 21) -> list[int]:
    """Reference fingerprints, fixed by their number, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}", 0)).astype(np.int64)) for i in range(count)]


def pivot_table(prints: DataFrame, count: int = 21) -> DataFrame:
    """Adds ``p0..``: Hamming distances of ``fp`` to the pivots, seven a long."""
    marks = pivots(count)
    for lane in range(0, count, _LANES):
        packed = F.lit(0).cast("long")
        for i, pivot in enumerate(marks[lane : lane + _LANES]):
            far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(pivot))).cast("long")
            packed = packed.bitwiseOR(F.shiftleft(far, 8 * i))
        prints = prints.withColumn(f"p{lane // _LANES}", packed)
    return prints


def key_masks(blocks: int, radius: int) -> list[int]:
    """Masks of the bits that a key fixes, as signed longs, one for each key."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    slices = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(slices, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(distinct: int, radius: int) -> int:
    """Slices so that a key's bits hold about as many values as there are fingerprints."""
    blocks = radius + 2
    while blocks < 2 * radius and distinct >> (64 * (blocks - radius) // blocks - 3):
        blocks += 1
    return blocks


def distances(marks: np.ndarray, count: int = 21) -> np.ndarray:
    """The pivot distance table: a row of Hamming distances to the pivots for each fingerprint."""
    near = np.array(pivots(count), np.int64).view(np.uint64)
    return np.bitwise_count(marks[:, None] ^ near[None, :]).astype(np.int16)


def _forest(radius: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links among a task's fingerprints.

    Rows stand in order of their first pivot distance, so those that can link to
    one are a window of it; the table's other coordinates discard most of the
    window and the exact distance verifies what is left.
    """
    marks = np.unique(pdf["fp"].to_numpy()).view(np.uint64)
    table = distances(marks, 4)
    order = np.argsort(table[:, 0], kind="stable")
    marks, table = marks[order], table[order]
    left, right = [], []
    rest = np.arange(len(marks))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            low, high = np.searchsorted(table[rest, 0], [table[one, 0] - radius, table[one, 0] + radius + 1])
            window = rest[low:high]
            kept = np.flatnonzero(np.abs(table[window, 1:] - table[one, 1:]).max(axis=1, initial=0) <= radius)
            kept = kept[np.bitwise_count(marks[window[kept]] ^ marks[one]) <= radius]
            if len(kept):
                hits = window[kept]
                left.append(np.full(len(hits), marks[one]))
                right.append(marks[hits])
                todo.extend(hits)
                rest = np.delete(rest, low + kept)
    empty = np.empty(0, dtype=np.uint64)
    a, b = (np.concatenate(x or [empty]).view(np.int64) for x in (left, right))
    return pd.DataFrame({"a": a, "b": b})


def links(prints: DataFrame, radius: int = 4, hot: int = 64, block_rows: int = 8192) -> DataFrame:
    """Edges ``(a, b)`` over distinct ``fp`` that connect exactly what links connect.

    Ordinary keys give every linked pair once; a key of more than ``hot``
    fingerprints gives a spanning forest of its links.
    """
    table = cut(pivot_table(prints.select("fp").distinct()))
    masks = key_masks(blocks_for(table.count(), radius), radius)
    cols = [c for c in table.columns if c.startswith("p")]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    keyed = table.select("fp", *cols, F.explode(keys).alias("k")).select("fp", *cols, "k.band", "k.key")
    crowded = cut(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot))
    calm = keyed.join(crowded, ["band", "key"], "left_anti")

    a, b = calm.alias("a"), calm.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = reduce(
        lambda other, im: F.when(differ.bitwiseAND(F.lit(im[1])) == 0, im[0]).otherwise(other),
        reversed(list(enumerate(masks))),
        F.lit(-1),
    )
    near = reduce(and_, [_within(F.col(f"a.{c}"), F.col(f"b.{c}"), radius) for c in cols])
    pairs = a.join(
        b,
        (F.col("a.band") == F.col("b.band"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & near
        & (F.bit_count(differ) <= radius)
        & (first == F.col("a.band")),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    parts = F.ceil(F.col("n") / block_rows).cast("int")
    packed = keyed.join(crowded, ["band", "key"]).select(
        "band", "key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("mine")
    )
    meet = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("mine"))
    )
    dealt = packed.select("band", "key", "fp", "mine", F.explode(meet).alias("other")).select(
        "band", "key", "fp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
    )
    forest = dealt.groupBy("band", "key", "i", "j").applyInPandas(
        lambda pdf: _forest(radius, pdf[["fp"]]), "a long, b long"
    )
    return pairs.union(forest)


def _rooted(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Rows with their fingerprint ``fp``, the ``root`` of its component and that component's least id."""
    prints = cut(fingerprints(docs, shingle))
    own = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = connected_components(links(own, radius), "a", "b")
    rooted = cut(
        own.join(joined.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    )
    # a component of very many fingerprints meets its least id in salted parts
    salt = F.pmod(F.xxhash64("fp"), F.lit(_SALTS))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    every = named.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    labels = cut(rooted.withColumn("salt", salt).join(every, ["root", "salt"]).select("fp", "root", "component_id"))
    return prints.join(labels, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: its fingerprint and its component.

    Columns ``doc_id``, ``fingerprint`` (16 lower-case hex digits),
    ``component_id`` (least ``doc_id`` reachable over links, itself included)
    and ``text_key`` (hash of the text, to tell rows with a repeated id apart).
    Null and word-less texts have fingerprint zero and link like any other; a
    null ``doc_id`` keeps its row and never names a component unless no
    member has an id; repeated rows are all returned; an empty table gives
    no rows; other columns do not matter.
    """
    return _rooted(docs, shingle, radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key"
    )


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stand for their component: its least ``(doc_id, text_key)``.

    Components never meet: null ids and an id that unrelated texts repeat keep
    a row for each component. Repeated rows count as copies of each other, so
    one of them stays. All columns of ``docs`` are kept.
    """
    return keep_least(docs, cut(_rooted(docs, shingle, radius)))
