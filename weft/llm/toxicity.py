"""Toxic documents by multiple-instance learning with noisy-or.

A document is a bag of sentences. Each sentence has a logistic score over hashed
five-byte windows of its lower-cased bytes; the document's score is one minus
the product of the sentences' complements (noisy-or). Only documents have labels,
so the gradient of a document's likelihood is passed down to its sentences; the
trained sentence scores then point at the offending ones.

The classifier is fitted on the driver to a bounded sample (``max_docs`` rows of
each class, by hash of the id, none over ``max_chars`` characters); rows of a
class weigh as much as the whole class. Scoring reads every whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 5
BITS = 18
CHUNK = 1 << 19
_P = 2654435761


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def _tables() -> tuple[bytes, np.ndarray]:
    """Byte map (A-Z lower-cased, other ASCII but letters and digits to a space) and sentence marks."""
    low = bytearray(range(256))
    for b in range(128):
        ch = chr(b).lower()
        low[b] = ord(ch) if ch.isalnum() else 0x20
    stop = np.zeros(256, dtype=bool)
    stop[[ord(c) for c in ".!?"]] = True
    return bytes(low), stop


_LOW, _STOP = _tables()


def sentence_starts(raw: np.ndarray) -> np.ndarray:
    """Byte offsets where sentences start: after a line end, or after . ! ? and a space."""
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    line = raw == 10
    gap = (raw == 32) | line
    cut = line.copy()
    cut[1:] |= gap[1:] & _STOP[raw[:-1]]
    starts = np.flatnonzero(cut) + 1
    return np.concatenate(([0], starts[starts < len(raw)]))


def features(text: bytes) -> np.ndarray:
    """A hashed feature for each byte: the window of ``GRAM`` bytes that starts there."""
    arr = np.frombuffer(text.translate(_LOW) + b" " * (GRAM - 1), dtype=np.uint8).astype(np.uint32)
    h = arr[: len(arr) - GRAM + 1].copy()
    for j in range(1, GRAM):
        h *= np.uint32(0x01000193)
        h ^= arr[j : len(arr) - GRAM + 1 + j]
    h *= np.uint32(_P)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def sentence_logits(text: bytes, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Where sentences start, and the log-odds of each."""
    raw = np.frombuffer(text, dtype=np.uint8)
    starts = sentence_starts(raw)
    if not len(starts):
        return starts, np.empty(0)
    sums = np.zeros(len(starts))
    for at in range(0, len(raw), CHUNK):  # bounded memory for very long texts
        end = min(len(raw), at + CHUNK)
        w = model.weights[features(text[at : end + GRAM - 1])[: end - at]]
        a = int(np.searchsorted(starts, at, "right")) - 1
        b = int(np.searchsorted(starts, end, "left"))
        sums[a:b] += np.add.reduceat(w, np.maximum(starts[a:b] - at, 0), dtype=np.float64)
    return starts, sums + model.bias


def score(text: bytes | None, model: Model) -> tuple[float, int, int, int]:
    """Document score, sentences, and the worst sentence as a byte range; no sentence scores 0."""
    data = text or b""
    starts, logits = sentence_logits(data, model)
    if not len(starts):
        return 0.0, 0, 0, 0
    worst = int(np.argmax(logits))
    end = int(starts[worst + 1]) if worst + 1 < len(starts) else len(data)
    return float(-np.expm1(-np.logaddexp(0.0, logits).sum())), len(starts), int(starts[worst]), end


def _telling(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, least: int = 3, lift: float = 3.0) -> np.ndarray:
    """Features in at least ``least`` toxic documents and ``lift`` times likelier there than elsewhere."""
    seen, mass = np.zeros((2, 1 << BITS)), np.zeros(2)
    count = np.zeros(1 << BITS, np.int32)
    for bag, y, weight in zip(bags, labels, weights):
        own = np.unique(bag)
        seen[int(y), own] += weight
        mass[int(y)] += weight
        count[own] += int(y)
    unit = weights.max()
    return (count >= least) & ((seen[1] + 0.0) / mass[1] > lift * (seen[0] + 0.5 * unit) / (mass[0] + unit))


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 12, batch: int = 48, rate: float = 0.03, decay: float = 1e-5, seed: int = 7) -> Model:
    """Minimises the weighted log loss of noisy-or bags by Adam. One class alone gives a constant model."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS, np.float32), 8.0 if len(labels) and labels[0] else -30.0)
    bags = []
    for t in texts:
        starts = sentence_starts(np.frombuffer(t, dtype=np.uint8))
        bags.append((features(t)[: len(t)], starts) if len(starts) else (np.empty(0, np.int32), starts))
    size = 1 << BITS
    telling = np.append(_telling([b[0] for b in bags], labels, weights), True)
    w, m, v = (np.zeros(size + 1, np.float32) for _ in range(3))
    w[size] = -7.0
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = [i for i in order[at : at + batch] if len(bags[i][1])]
            if not pick:
                continue
            idx = np.concatenate([bags[i][0] for i in pick])
            shift = np.cumsum([0] + [len(bags[i][0]) for i in pick])
            starts = np.concatenate([bags[i][1] + s for i, s in zip(pick, shift)])
            count = np.array([len(bags[i][1]) for i in pick])
            first = np.cumsum(count) - count
            logits = np.add.reduceat(w[idx], starts, dtype=np.float64) + w[size]
            p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            none = np.exp(-np.add.reduceat(np.logaddexp(0.0, logits), first))  # no sentence is toxic
            y = labels[pick]
            pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-6), 1.0) * weights[pick]
            grad_s = np.repeat(pull, count) * p / len(pick)
            grad = np.bincount(idx, np.repeat(grad_s, np.diff(np.append(starts, len(idx)))), size + 1)
            grad[size] = grad_s.sum()
            grad[:size] += decay * w[:size]
            grad[~telling] = 0.0
            step += 1
            m += 0.1 * (grad - m).astype(np.float32)
            v += 0.01 * (np.square(grad) - v).astype(np.float32)
            slow = rate * (1.0 if epoch < epochs - 2 else 0.4)
            w -= (slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(w[:size], float(w[size]))


def held_out(folds: int = 5) -> Column:
    """True for rows whose crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 2500, max_chars: int = 20_000, **fitting: object) -> Model:
    """Fit on labelled documents outside the held-out fold.

    Rows without a label, with a null label or id are left out; a repeated id
    counts as toxic if any of its labels is, and stands for its least text. No
    text goes to the driver but those of the sample, at most ``2 * max_docs`` of
    ``max_chars`` characters. Without labels the model finds nothing toxic.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
        .where(~held_out())
        .withColumn("draw", F.xxhash64("doc_id", F.lit(31)))
    )
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == y).orderBy("draw", "doc_id").limit(max_docs) for y in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))  # at most 2 * max_docs rows of three numbers
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .where(F.length("text") <= max_chars)
        .join(sample, "doc_id")
        .groupBy("doc_id", "draw", "toxic")
        .agg(F.min("text").cast("binary").alias("text"))
        .toArrow()
        .sort_by([("draw", "ascending"), ("doc_id", "ascending")])
    )
    y = rows.column("toxic").to_numpy()
    shown = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    rate = {k: totals.get(k, 0) / shown[k] for k in (0, 1)}
    scale = max(rate.values(), default=0) or 1.0
    weights = np.array([rate[int(k)] / scale for k in y])
    return fit(rows.column("text").to_pylist(), y, weights, **fitting)


def _shared(spark: SparkSession, model: Model) -> object:
    """The model for all tasks: one fixed table of 2 ** BITS weights, whatever the input."""
    return spark.sparkContext.broadcast(pickle.dumps((model.weights, model.bias)))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_sentences, worst_start, worst_end)`` for every row.

    ``worst_start`` and ``worst_end`` are code point offsets of the sentence with
    the highest score. Null and empty texts have no sentence and score 0; repeated
    rows and null ids are scored like others; an empty table gives no rows; other
    columns, ``lang`` and ``source`` among them, are never read.
    """
    shared = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*pickle.loads(shared.value))
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for x in batch.column(2):
                text = x.as_py() or b""
                s, n, a, b = score(text, own)
                head = len(text[:a].decode("utf-8", "replace"))
                values = (s, n, head, head + len(text[a:b].decode("utf-8", "replace")))
                for col, value in zip(cols, values):
                    col.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.float64()), pa.array([int(s >= 0.5) for s in cols[0]], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                names=["doc_id", "held_out", "score", "predicted", "n_sentences", "worst_start", "worst_end"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_sentences long, worst_start long, worst_end long")


def offending(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, sentence, start, end, score)`` for every sentence that scores ``threshold`` or more.

    ``start`` and ``end`` are code point offsets, ``sentence`` counts from 0. Null
    and empty texts have no sentence; repeated rows repeat theirs; an empty table
    gives no rows; other columns do not matter.
    """
    shared = _shared(docs.sparkSession, model)
    kind = "doc_id long, sentence long, start long, end long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*pickle.loads(shared.value))
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py() or b""
                starts, logits = sentence_logits(text, own)
                found = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
                hits = np.flatnonzero(found >= threshold)
                if not len(hits):
                    continue
                points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                ends = np.append(starts[1:], len(text))
                for col, values in zip(cols, ([doc] * len(hits), hits, points[starts[hits]], points[ends[hits]], found[hits])):
                    col.extend(values)
            types = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in kind.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, kind)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``threshold``; no shuffle."""
    shared = _shared(docs.sparkSession, model)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*pickle.loads(shared.value))
        for texts in batches:
            yield texts.map(lambda t: score(None if t is None else bytes(t), own)[0] < threshold).astype(bool)

    return docs.where(clean(F.col("text").cast("binary")))
