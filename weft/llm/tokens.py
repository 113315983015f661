"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole; each token's span of bytes comes from the
sizes of its predecessors. Spans are joined to the document's sections as
intervals, by binary search in the sorted boundaries, inside the task that holds
the text. A token that crosses a boundary belongs to the section with most of
its bytes, the earlier one if equal (rule ``most``), or to the section of its
first byte (rule ``first``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import vocab

_COLUMNS = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def line_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which lines start; a line end belongs to the line before it."""
    arr = np.frombuffer(data, dtype=np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(arr == 10) + 1))
    return starts[starts < len(arr)] if len(arr) else starts


def attribute(sizes: np.ndarray, starts: np.ndarray, total: int, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and of those the ones that cross a boundary."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    bounds = np.append(starts, total)
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    owner = first.copy()
    crossing = first != last
    if rule == "most":
        for i in np.flatnonzero(crossing):
            parts = np.arange(first[i], last[i] + 1)
            shares = np.minimum(bounds[parts + 1], ends[i]) - np.maximum(bounds[parts], begins[i])
            owner[i] = parts[np.argmax(shares)]
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(docs: DataFrame, ranks: str = vocab.RANKS, rule: str = "most") -> DataFrame:
    """One row for each line of each text: its span in code points and its tokens.

    Columns ``doc_id, section, start, end, n_tokens, n_crossing, doc_tokens``; a
    document's ``n_tokens`` add up to ``doc_tokens``. Null and empty texts have one
    section without tokens; repeated rows and null ids are counted like others; an
    empty table gives no rows; other columns do not matter.
    """
    shared = vocab.shared(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = vocab.encoding(shared.value)
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py() or ""
                data = text.encode("utf-8")
                sizes = lengths[np.array(encoder.encode_ordinary(text), dtype=np.int64)]
                starts = line_starts(data)
                given, crossing = attribute(sizes, starts, len(data), rule)
                arr = np.frombuffer(data, dtype=np.uint8)
                points = np.concatenate(([0], np.cumsum((arr & 0xC0) != 0x80)))
                n = len(starts)
                marks = points[np.append(starts, len(data))]
                cols[0] += [doc] * n
                values = (np.arange(n), marks[:-1], marks[1:], given, crossing, np.full(n, len(sizes)))
                for col, value in zip(cols[1:], values):
                    col.append(value)
            rest = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *rest], names=[c.split()[0] for c in _COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _COLUMNS)
