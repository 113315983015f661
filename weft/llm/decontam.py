"""Benchmark passages in documents, by q-gram lemma filtering.

Items and texts are compared as lower-cased letters and digits with one space
for whatever lies between. Each item is cut into overlapping segments of
``length`` characters, ``step`` apart (shorter items are one segment), and may
differ from a text by ``budget = rate * length`` edits, so an excerpt of ``length
+ step`` characters is found wherever it was cut. Items of under ``MIN_CHARS``
characters must occur as they are, between spaces or ends; items of fewer
characters than a q-gram, as the whole of a text. Two strings within k edits share at
least ``length - q + 1 - k q`` q-grams (the q-gram lemma), all of them on
diagonals (place in the text minus place in the item) that span at most k, so

1. a text goes on only if some stretch as long as a segment holds that many
   places whose q-gram is in the index at all,
2. its hits are counted by segment in overlapping bands of diagonals, each twice
   the budget wide, and bands that meet the bound are kept,
3. each kept region is verified by banded alignment.

The benchmark is the query set: it is read in blocks of bounded size, each an
index in memory that scans all documents in place. Documents are not shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 12
LENGTH = 60
STEP = 15
RATE = 1 / 20
MIN_CHARS = 32
POSTINGS = 1_000_000
BLOCK_CHARS = 4_000_000
_BITS = 22
_PRIME = 0x9E3779B97F4A7C15


def letter_table() -> np.ndarray:
    """For each code point of the basic plane its lower case, or 32 if neither letter nor digit."""
    out = np.arange(65_536, dtype=np.uint32)
    for cp in range(65_536):
        ch = chr(cp)
        if not ch.isalnum():
            out[cp] = 32
        elif len(ch.lower()) == 1:
            out[cp] = ord(ch.lower())
    return out


def normal(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compared code points, and the place of each in ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.where(codes < 65_536, table[np.minimum(codes, 65_535)], codes)
    space = low == 32
    keep = np.flatnonzero(~(space & np.concatenate(([True], space[:-1]))))
    return low[keep], keep


def _trim(codes: np.ndarray) -> np.ndarray:
    codes = codes[1:] if len(codes) and codes[0] == 32 else codes
    return codes[:-1] if len(codes) and codes[-1] == 32 else codes


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = codes[:n].astype(np.uint64)
    for j in range(1, q):
        acc *= np.uint64(_PRIME)
        acc += codes[j : n + j]
    return acc ^ (acc >> np.uint64(29))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(_PRIME)) >> np.uint64(64 - _BITS)


@dataclass
class Index:
    """One block of items: segments, and for each q-gram the segments and places it has."""

    q: int
    table: np.ndarray
    items: list[tuple[int, np.ndarray]]
    seg_item: np.ndarray
    seg_start: np.ndarray
    seg_len: np.ndarray
    seg_edits: np.ndarray
    seg_bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    posts_seg: np.ndarray
    posts_at: np.ndarray
    cells: np.ndarray
    tiny: dict[bytes, list[int]]
    min_chars: int


def build(items: list[tuple[int, str | None]], q: int = Q, length: int = LENGTH, step: int = STEP, rate: float = RATE, min_chars: int = MIN_CHARS) -> Index:
    """The index of ``(item_id, text)``; items under ``min_chars`` compared characters must match exactly."""
    table = letter_table()
    clean, tiny = [], {}
    for i, text in items:
        c = _trim(normal(text or "", table)[0])
        if len(c) >= q:
            clean.append((i, c))
        elif len(c):
            tiny.setdefault(c.tobytes(), []).append(i)
    segs = []
    for n, (_, c) in enumerate(clean):
        span = min(length, len(c))
        for start in sorted({*range(0, len(c) - span + 1, step), len(c) - span}):
            segs.append((n, start, span))
    seg = np.array(segs, dtype=np.int64).reshape(-1, 3)
    edits = np.minimum((seg[:, 2] * rate).astype(np.int64), np.maximum(0, (seg[:, 2] - q) // q))
    edits[seg[:, 2] < min_chars] = 0
    bound = seg[:, 2] - q + 1 - edits * q
    hashes, owner, place = [], [], []
    for s, (n, start, span) in enumerate(segs):
        g = grams(clean[n][1][start : start + span], q)
        hashes.append(g)
        owner.append(np.full(len(g), s))
        place.append(np.arange(start, start + len(g)))
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    cells = np.zeros(1 << _BITS, dtype=bool)
    cells[_cell(keys)] = True
    none = np.empty(0, np.int64)
    return Index(
        q, table, clean, seg[:, 0], seg[:, 1], seg[:, 2], edits, bound, keys, np.append(first, len(h)),
        np.concatenate(owner)[order] if owner else none, np.concatenate(place)[order] if place else none, cells, tiny, min_chars,
    )


def banded(segment: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits of ``segment`` against any stretch of ``text`` whose diagonals stay in [low, high], and its end."""
    width = high - low + 1
    steps = np.arange(width)
    row = np.zeros(width, dtype=np.int64)
    far = len(segment) + len(text) + 1
    for i, code in enumerate(segment):
        j = i + low + steps
        inside = (j >= 0) & (j < len(text))
        same = inside & (text[np.clip(j, 0, max(0, len(text) - 1))] == code)
        best = np.where(inside, row + ~same, far)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[-1] = min(best[-1], row[-1] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    at = int(np.argmin(row))
    return int(row[at]), len(segment) + low + at


def matches(text: str | None, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """``(item_id, segments, matched segments, edits, start, end)`` of items in ``text``.

    Edits are the least of the matched segments; start and end are code point
    offsets around all of them.
    """
    if not text:
        return []
    codes, places = normal(text, index.table)
    out = [(i, 1, 1, 0, 0, len(text)) for i in index.tiny.get(_trim(codes).tobytes(), ())] if index.tiny and len(codes) < index.q + 2 else []
    return sorted(out + _segments(codes, places, index)) if len(index.keys) else sorted(out)


def _segments(codes: np.ndarray, places: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    hashes = grams(codes, index.q)
    least = int(index.seg_bound.min())
    if len(hashes) < least:
        return []
    hit = index.cells[_cell(hashes)]
    span = int((index.seg_len + index.seg_edits).max())
    total = np.concatenate(([0], np.cumsum(hit)))
    if (total[min(span, len(hit)) :] - total[: len(total) - min(span, len(hit))]).max() < least:
        return []
    at = np.flatnonzero(hit)
    slot = np.searchsorted(index.keys, hashes[at])
    slot = np.minimum(slot, len(index.keys) - 1)
    ok = index.keys[slot] == hashes[at]
    at, slot = at[ok], slot[ok]
    # stretches that are dense enough, by true hits
    dense = np.zeros(len(hashes) + 1, dtype=np.int64)
    dense[at + 1] = 1
    total = np.cumsum(dense)
    ahead, behind = np.minimum(at + span, len(hashes)), np.maximum(at - span, 0)
    ok = (total[ahead] - total[at] >= least) | (total[at + 1] - total[behind] >= least) | (total[ahead] - total[behind] >= least)
    at, slot = at[ok], slot[ok]
    found: dict[int, list] = {}
    many = index.first[slot + 1] - index.first[slot]
    part = (np.cumsum(many) - many) // POSTINGS  # a bounded number of postings at a time; counts add up
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(at)])) if len(at) else []
    keys, counts = [], []
    for x, y in zip(edges, edges[1:]):
        a, n, first = at[x:y], many[x:y], index.first[slot[x:y]]
        post = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seg = index.posts_seg[post]
        low = (np.repeat(a, n) - index.posts_at[post]) // (index.seg_edits[seg] + 1)
        # bands two budgets wide, overlapping by half; segment and band in one number
        key, count = np.unique(np.concatenate([(seg << 36) + (low + (1 << 34)), (seg << 36) + (low - 1 + (1 << 34))]), return_counts=True)
        keys.append(key)
        counts.append(count)
    key, where = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
    total = np.bincount(where, np.concatenate(counts), len(key)) if len(key) else np.empty(0)
    ok = total >= index.seg_bound[key >> 36]
    seen = [((int(k) >> 36, (int(k) & ((1 << 36) - 1)) - (1 << 34)), int(m)) for k, m in zip(key[ok], total[ok])]
    matched: set[int] = set()
    for (g, c), _ in seen:
        if g in matched:
            continue
        item, start, size, edits = (int(x[g]) for x in (index.seg_item, index.seg_start, index.seg_len, index.seg_edits))
        segment = index.items[item][1][start : start + size]
        low = start + c * (edits + 1)  # where the segment starts in the text, at the band's edges
        high = low + 2 * (edits + 1) - 1
        base = max(0, low - edits)
        region = codes[base : max(base, high + size + edits)]
        at_once = region.tobytes().find(segment.tobytes())  # most passages are verbatim; no edits to align then
        if at_once >= 0 and at_once % 4 == 0:
            need, end = 0, at_once // 4 + size
        else:
            need, end = banded(segment, region, low - edits - base, high + edits - base)
        if need <= edits:
            end = min(max(end, 1), len(region))
            first = base + max(0, end - size)
            if size < index.min_chars and not _alone(codes, first, base + end):
                continue
            matched.add(g)
            found.setdefault(item, []).append((g, need, base + max(0, end - size), base + end))
    out = []
    for item, hits in found.items():
        begin, end = min(h[2] for h in hits), max(h[3] for h in hits)
        out.append((index.items[item][0], int((index.seg_item == item).sum()), len(hits), min(h[1] for h in hits), int(places[begin]), int(places[end - 1]) + 1))
    return out


def _alone(codes: np.ndarray, first: int, end: int) -> bool:
    """True if spaces or the text's ends are on both sides."""
    return (first == 0 or codes[first - 1] == 32) and (end == len(codes) or codes[end] == 32)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **rules: object) -> Iterator[Index]:
    """Indexes over blocks of items, each of at most ``block_chars`` characters (or one longer item)."""
    rows, size = [], 0
    chosen = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    for row in chosen.toLocalIterator():
        if rows and size + len(row["text"]) > block_chars:
            yield build(rows, **rules)
            rows, size = [], 0
        rows.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if rows:
        yield build(sorted(rows), **rules)


def find(docs: DataFrame, benchmark: DataFrame, **rules: object) -> DataFrame:
    """``(doc_id, item_id, n_segments, n_matched, edits, start, end)``: one row a document and item found in it.

    Null and empty texts and items match nothing, nor do items without a letter
    or digit or with a null id; repeated items or documents repeat rows; an empty
    table on either side gives no rows; other columns do not matter.
    """
    kind = "doc_id long, item_id long, n_segments long, n_matched long, edits long, start long, end long"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], kind)
    for index in blocks(benchmark, **rules):
        shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index.__dict__))

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            own = Index(**pickle.loads(shared.value))
            for batch in batches:
                rows = [(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1)) for m in matches(t.as_py(), own)]
                cols = list(zip(*rows)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_segments", "n_matched", "edits", "start", "end"]
                )

        out = out.union(slim.mapInArrow(run, kind))
    return out


def _is_clean(shared: object) -> object:
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Index(**pickle.loads(shared.value))
        for texts in batches:
            yield texts.map(lambda t: not matches(t, own)).astype(bool)

    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame, **rules: object) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item is found; no shuffle."""
    spark = docs.sparkSession
    for index in blocks(benchmark, **rules):
        shared = spark.sparkContext.broadcast(pickle.dumps(index.__dict__))
        docs = docs.where(_is_clean(shared)(F.col("text")))
    return docs
