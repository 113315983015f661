"""Repeated passages by level-wise doubling of word windows.

Windows of ``base`` words that occur in two different texts are extended to
twice that length, those still repeated are extended again, and so on until the
``window`` length is reached or no candidate survives. A window of 2n words is
repeated only if both its halves are, so no repeat is lost on the way.

The first level is thinned without loss: of the base windows inside each full
window only the one with the least hash is kept (its anchor). Equal full
windows have equal anchors, so about two in eleven base windows suffice for 4
and 13 words. At each later level an anchor is extended to its left and to its
right, since every full window around it holds one of the two extensions whole.
The last level compares whole windows by two independent 64-bit hashes and
finds the least ``doc_id`` each starts in.

Passages that very many documents share are known beforehand from a sample of
texts (``_SAMPLE``): a window that two sampled texts hold is repeated, so at the
earlier levels its rows need not meet and are dealt at random. At the last level
they are dealt by window and salt; the least row of each salt then meets those of
the other salts. The sample decides where rows go, never what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.text import bounds, hash_words, mix64, roll, signed
from weft.session import cut, shuffle_partitions

WINDOW = 13
BASE = 4
_LAST = 2**63 - 1
_SAMPLE = 1024
_OFTEN = 65_536
_SALTS = 64
_CHECK = np.uint64(0x5851F42D4C957F2D)


def levels(window: int = WINDOW, base: int = BASE) -> list[int]:
    """Window lengths: ``base``, doubling while no repeat can be lost, and last ``window``.

    A window holds the left or the right extension of its anchor whole as long
    as twice the extension is no longer than ``window + base + 1``.
    """
    out = [min(base, window)]
    while 4 * out[-1] <= window + base + 1:
        out.append(2 * out[-1])
    return out if out[-1] == window else [*out, window]


def _slide(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some ``width`` consecutive ones."""
    if len(grams) < width:
        return np.empty(0, dtype=np.int64)
    least = _slide(grams, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    best = _slide(np.concatenate((pad, least, pad)), width, np.maximum)
    return np.flatnonzero(best == grams)


def _rows(names: list[str], cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


class _Out:
    """Gathers arrays and gives out batches of bounded size."""

    def __init__(self, names: list[str], rows: int = 200_000):
        self.names, self.rows, self.n = names, rows, 0
        self.parts: list[list[np.ndarray]] = [[] for _ in names]

    def add(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, col in zip(self.parts, cols):
            part.append(col)
        self.n += len(cols[0])
        if self.n >= self.rows:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield _rows(self.names, [np.concatenate(p) for p in self.parts])
        self.n, self.parts = 0, [[] for _ in self.names]


def _grams(words: np.ndarray, length: int, side: int | None = None) -> np.ndarray:
    """Keys of all windows of ``length`` words, as extensions to the left (0) or right (1) if ``side`` is given."""
    found = roll(words, length)
    return found if side is None else mix64(found + np.uint64(side))


def _check(words: np.ndarray, window: int) -> np.ndarray:
    return roll(mix64(words ^ _CHECK), window)


def _is_in(keys: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are among the sorted ``often``."""
    if not len(often):
        return np.zeros(len(keys), bool)
    return often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys


def _dealt_apart(keys: np.ndarray, sure: np.ndarray, row: int, at: np.ndarray) -> np.ndarray:
    """Keys to shuffle by: those of windows known as repeated give way to random ones."""
    out = signed(keys).copy()
    out[sure] = signed(mix64(at[sure].astype(np.uint64) + mix64(np.array([row], np.int64).view(np.uint64))))
    return out


def _signed_at(at: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Places, below zero for windows known as common: one column less to shuffle."""
    return np.where(common, -1 - at, at).astype(np.int32)


def _sampled(window: int, steps: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct window keys of each text, by level."""
    for batch in batches:
        for text in batch.column(0):
            words = hash_words(text.as_py() or b"")
            for i, length in enumerate(steps):
                if i in (0, len(steps) - 1):
                    found = np.unique(_grams(words, length))
                else:
                    found = np.unique(np.concatenate([_grams(words, length, side) for side in (0, 1)]))
                yield _rows(["level", "key"], [np.full(len(found), i, np.int32), signed(found)])


def often_keys(texts: DataFrame, window: int, steps: list[int]) -> list[np.ndarray]:
    """For each level the window keys that most sampled texts share, sorted: at most ``_OFTEN`` a level."""
    every = max(1, texts.count() // _SAMPLE)
    few = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(every)) == 0).groupBy("text_key").agg(F.first("text").alias("text"))
    found = few.select("text").mapInArrow(partial(_sampled, window, steps), "level int, key long")
    counted = cut(found.groupBy("level", "key").count().where("count > 1"))
    out = []
    for i in range(len(steps)):
        top = counted.where(F.col("level") == i).orderBy(F.desc("count"), "key").limit(_OFTEN).select("key").collect()
        out.append(np.sort(np.array([r["key"] for r in top], np.int64).view(np.uint64)))
    return out


def _first_level(window: int, base: int, often: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out(["key", "text_key", "row", "at"])
    known = often.value[0]
    for batch in batches:
        rows, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for row, key, text in zip(rows, keys, batch.column(2)):
            words = hash_words(text.as_py() or b"")
            if len(words) < window:
                continue
            grams = _grams(words, base)
            at = anchors(grams, window - base + 1)
            sure = _is_in(grams[at], known)
            yield from out.add(_dealt_apart(grams[at], sure, row, at), np.full(len(at), key), np.full(len(at), row), _signed_at(2 * at + 1, sure))
    yield from out.flush()


def _extend(base: int, length: int, level: int, often: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both extensions to ``length`` words of each surviving anchor.

    Places travel as twice the anchor's, plus one for the extension to the right.
    """
    out = _Out(["key", "text_key", "row", "at"])
    known = often.value[level]
    for batch in batches:
        rows, texts, places, keys = (batch.column(i) for i in (0, 2, 3, 4))
        for row, key, text, at in zip(rows.to_numpy(), keys.to_numpy(), texts, places):
            at = np.unique(at.values.to_numpy() >> 1)
            words = hash_words(text.as_py())
            for side, start in ((0, at - (length - base)), (1, at)):
                grams = _grams(words, length, side)
                ok = (start >= 0) & (start < len(grams))
                found, place = grams[start[ok]], 2 * at[ok] + side
                sure = _is_in(found, known)
                yield from out.add(_dealt_apart(found, sure, row, place), np.full(len(found), key), np.full(len(found), row), _signed_at(place, sure))
    yield from out.flush()


def _last_level(window: int, base: int, length: int, often: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every full window around a surviving extension of ``length`` words, under two hashes, the second salted if it is common."""
    out = _Out(["key", "check", "doc_id", "row", "at"])
    known = often.value[-1]
    for batch in batches:
        rows, docs, texts, places = (batch.column(i) for i in range(4))
        for row, doc, text, at in zip(rows.to_numpy(), docs.fill_null(_LAST).to_numpy(), texts, places):
            at = np.unique(at.values.to_numpy())
            begin = np.where(at & 1, at >> 1, (at >> 1) - (length - base))
            words = hash_words(text.as_py())
            starts = np.zeros(len(words) - window + 2, dtype=np.int64)
            np.add.at(starts, np.maximum(begin + length - window, 0), 1)
            np.add.at(starts, np.minimum(begin, len(words) - window) + 1, -1)
            start = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
            found = _grams(words, window)[start]
            common = _is_in(found, known)
            check = _check(words, window)[start]
            check[common] ^= np.uint64(int(row) % _SALTS)
            yield from out.add(signed(found), signed(check), np.full(len(start), doc), np.full(len(start), row), _signed_at(start, common))
    yield from out.flush()


def _strip(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts, places, copies = (batch.column(i) for i in range(1, 5))
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for text, at, copy in zip(texts, places, copies):
            words = (text.as_py() or b"").split()
            n_words.append(len(words))
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            if copy.as_py() and len(words) >= window:
                gone[0] += 1
            elif at.is_valid:
                start = np.unique(at.values.to_numpy())
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
            cover = np.cumsum(gone[:-1]) > 0
            n_removed.append(int(cover.sum()))
            kept = b" ".join(words if not n_removed[-1] else [w for w, c in zip(words, cover.tolist()) if not c])
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [docs, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(kept_texts)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def _survivors(rows: DataFrame) -> DataFrame:
    """``(row, at)`` of the windows that occur in two different texts, in one shuffle."""
    same = W.partitionBy("key")
    seen = rows.withColumn("low", F.min("text_key").over(same)).withColumn("high", F.max("text_key").over(same))
    return seen.where("at < 0 or low <> high").select("row", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).cast("int").alias("at"))


def _later(last: DataFrame) -> DataFrame:
    """``(row, at)`` of the full windows that also start in a document with a smaller id."""
    place = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).cast("int").alias("at")
    salted = last.withColumn("least", F.min("doc_id").over(W.partitionBy("key", "check")))
    # the least rows of each salt of a common window, at most one document a salt, meet once more
    open_ = salted.where((F.col("least") == F.col("doc_id")) & (F.col("at") < 0))
    plain = F.col("check").bitwiseXOR(F.pmod("row", F.lit(_SALTS)))
    settled = open_.withColumn("first", F.min("doc_id").over(W.partitionBy("key", plain))).where("first < doc_id")
    return salted.where("least < doc_id").select("row", place).union(settled.select("row", place))


def _by_row(places: DataFrame) -> DataFrame:
    return places.groupBy("row").agg(F.collect_list("at").alias("at"))


def strip_repeats(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """Every row of ``docs`` without the words that an earlier document has.

    A word goes if a window of ``window`` words covers it whose sequence also
    starts in a document with a smaller ``doc_id``; windows are judged on the
    input. Columns ``doc_id, n_words, n_removed, kept_sha256, kept_text``.

    Null or empty texts have no words and keep nothing; texts shorter than a
    window lose nothing; repeats inside one document alone stay; rows with a
    repeated ``doc_id`` count as one document, so they do not strip each other;
    a null ``doc_id`` is after all others and strips nothing elsewhere; an empty
    table gives no rows; other columns do not matter.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    base_rows = docs.select(
        F.xxhash64(ident, F.col("text")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    keyed = base_rows.withColumn("text_key", F.xxhash64("text"))
    kind = "key long, text_key long, row long, at int"
    steps = levels(window, base)
    often = docs.sparkSession.sparkContext.broadcast(often_keys(keyed.select("text_key", "text"), window, steps))
    found = _by_row(_survivors(keyed.select("row", "text_key", "text").mapInArrow(lambda it: _first_level(window, steps[0], often, it), kind)))
    # Of equal texts only the least doc_id goes on: all windows of the others start in it.
    slim = keyed.where("text is not null").select("row", "text_key", F.xxhash64(F.lit(1), "text").alias("check_key"), F.coalesce("doc_id", F.lit(_LAST)).alias("order_id"))
    least_id = slim.groupBy("text_key", "check_key").agg(F.min("order_id").alias("first_id"))
    copies = cut(
        slim.join(least_id, ["text_key", "check_key"]).where("order_id > first_id").groupBy("row").agg(F.lit(True).alias("copy"))
    )
    # The texts' only shuffle: all levels read the same columns of it, so it is made once.
    dealt = base_rows.repartition(shuffle_partitions(docs.sparkSession), "row")

    def carrying(places: DataFrame) -> DataFrame:
        return dealt.join(places.join(copies, "row", "left_anti").hint("shuffle_hash"), "row").select("row", "doc_id", "text", "at")

    for level, length in enumerate(steps[1:-1], 1):
        longer = carrying(found).withColumn("text_key", F.xxhash64("text"))
        found = _by_row(_survivors(longer.mapInArrow(lambda it, n=length, i=level: _extend(steps[0], n, i, often, it), kind)))
    before = steps[-2] if len(steps) > 1 else steps[0]
    last = carrying(found).mapInArrow(
        lambda it: _last_level(window, steps[0], before, often, it), "key long, check long, doc_id long, row long, at int"
    )
    later = _by_row(_later(last))
    return (
        dealt.join(later.hint("shuffle_hash"), "row", "left")
        .join(copies.hint("shuffle_hash"), "row", "left")
        .select("row", "doc_id", "text", "at", "copy")
        .mapInArrow(
            partial(_strip, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
        )
    )
