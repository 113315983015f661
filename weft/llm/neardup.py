"""Near copies by the exact Jaccard similarity of word shingles.

Two texts link if their sets of ``shingle``-word shingles have a similarity of
``LEAST`` or more. Candidates come from keys, are discarded by SimHash
fingerprints, and are verified on whole sets:

1. In any order of all shingles that both texts follow, a linked pair shares one
   of the first ``n - ceil(LEAST * n) + 1`` of its ``n`` shingles; these are a
   set's keys. The order puts shingles that a sample of texts repeats last, which
   keeps keys rare. The sample decides how many candidates there are, never which
   texts link.
2. Sets that share a key stay candidates if their 128-bit SimHash fingerprints
   differ in at most ``RADIUS`` bits. A linked pair differs in 15 to 19 % of its
   bits, five deviations less; unrelated sets differ in half of them. A pivot
   table discards first: by the triangle inequality a pair is too far apart if
   its distances to any pivot differ by more than ``RADIUS``. Unrelated sets
   differ by 8 on average there, so pivots out of the data serve, far from each
   other: one discards its own near copies against everything else.
3. A key of more than ``hot`` sets leaves the pair join. Its sets are dealt into
   blocks of bounded size; every two blocks meet in a task that returns a
   spanning forest of the candidates, never all pairs.
4. Components of candidates are dealt the same way with their texts, and tasks
   return a spanning forest of the links by exact similarity.

Equal sets are one node from the start, so copies never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.text import mix64, within
from weft.operators.components import connected_components
from weft.session import cut, shuffle_partitions, stash

#: Least similarity as numerator and denominator, so that comparisons are exact.
LEAST = (4, 5)
#: Most differing bits of 128 of a candidate.
RADIUS = 44
_SAMPLE = 4096
_PIVOTS = 7
_PIVOT_SAMPLE = 512
_OFTEN = 65_536
_LANE = np.uint64(0xA0761D6478BD642F)


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's word shingles.

    A-Z are lower-cased; fewer words than ``shingle`` make one shingle; no
    word at all gives none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    ends = stops[min(shingle, len(words)) - 1 :].tolist()
    starts = np.concatenate(([0], stops[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, ends)), np.uint64, n))


def _mark(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 0) if len(found) else 0


def simprint(found: np.ndarray) -> tuple[int, int]:
    """128 majority bits of a set of hashes, as two unsigned integers."""
    out = []
    for lane in (found, mix64(found ^ _LANE)):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(lane), 32_768):
            part = np.ascontiguousarray(lane[at : at + 32_768]).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(ones * 2 > len(lane)).tobytes(), "big"))
    return out[0], out[1]


def _first(found: np.ndarray, often: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The shingles that every partner must share one of."""
    take = len(found) - -(-LEAST[0] * len(found) // LEAST[1]) + 1
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        count = np.where(often[at] == found, seen[at], 0)
        found = found[np.argsort(count, kind="stable")]
    return found[:take]


_PRINT = "doc_id long, text_key long, fp long, n long, s0 long, s1 long, keys array<long>"


def _print_batches(shingle: int, often: np.ndarray, seen: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            cols: list[list] = [[], [], [], [], []]
            for text in part.column(2):
                found = shingles(text.as_py(), shingle)
                row = (_mark(found), len(found), *simprint(found), _first(found, often, seen).view(np.int64) if len(found) else [])
                for col, value in zip(cols, row):
                    col.append(value)
            longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[:4]]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *longs, pa.array(cols[4], pa.list_(pa.int64()))], names=[c.split()[0] for c in _PRINT.split(", ")])


def _shingle_batches(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), shingle).view(np.int64))], names=["s"])


def _spread(fps: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list, list]:
    """A spanning forest over ``fps``: ``near(i, rest)`` tells which of ``rest`` link to place ``i``."""
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            ok = near(one, rest)
            hits = rest[ok]
            if len(hits):
                left.append(np.full(len(hits), fps[one]))
                right.append(fps[hits])
                todo.extend(hits)
                rest = rest[~ok]
    return left, right


def _far(s0: np.ndarray, s1: np.ndarray, one: int) -> np.ndarray:
    return np.bitwise_count(s0 ^ s0[one]).astype(np.int16) + np.bitwise_count(s1 ^ s1[one])


def pivots(s0: np.ndarray, s1: np.ndarray, count: int = _PIVOTS) -> list[int]:
    """Places of up to ``count`` fingerprints, each the one farthest from those before it."""
    found = [0] if len(s0) else []
    least = _far(s0, s1, 0) if found else s0
    while 0 < len(found) < count and least.max() > 0:
        found.append(int(least.argmax()))
        least = np.minimum(least, _far(s0, s1, found[-1]))
    return found


def _candidate_forest(pdf: pd.DataFrame, radius: int) -> tuple[list, list]:
    fps, n = pdf["fp"].to_numpy(), pdf["n"].to_numpy()
    s0, s1 = pdf["s0"].to_numpy().view(np.uint64), pdf["s1"].to_numpy().view(np.uint64)

    table = [_far(s0, s1, p) for p in pivots(s0, s1)]

    def near(one: int, rest: np.ndarray) -> np.ndarray:
        left = np.ones(len(rest), bool)
        for column in table:
            left &= np.abs(column[rest] - column[one]) <= radius
        ok = np.flatnonzero(left)
        far = np.bitwise_count(s0[rest[ok]] ^ s0[one]).astype(np.int64) + np.bitwise_count(s1[rest[ok]] ^ s1[one])
        left[ok] = far <= radius
        return left & (n[rest] * LEAST[1] >= n[one] * LEAST[0]) & (n[one] * LEAST[1] >= n[rest] * LEAST[0])

    return _spread(fps, near)


def _link_forest(pdf: pd.DataFrame, shingle: int) -> tuple[list, list]:
    fps = pdf["fp"].to_numpy()
    sets = [shingles(t, shingle) for t in pdf["text"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    words, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    flag = np.zeros(len(words), np.int64)
    view = [codes, starts, np.arange(len(fps))]

    def near(one: int, rest: np.ndarray) -> np.ndarray:
        if len(rest) < len(view[2]) // 2:  # keep only what is left, now and then
            view[0] = np.concatenate([codes[starts[r] : starts[r] + sizes[r]] for r in rest])
            view[1], view[2] = np.cumsum(sizes[rest]) - sizes[rest], rest
        mine = codes[starts[one] : starts[one] + sizes[one]]
        flag[mine] = 1
        both = np.add.reduceat(flag[view[0]], view[1])
        flag[mine] = 0
        both = both[np.searchsorted(view[2], rest)]
        return both * sum(LEAST) >= LEAST[0] * (sizes[rest] + sizes[one])

    return _spread(fps, near)


def _in_groups(forest: Callable[[pd.DataFrame], tuple[list, list]], pdf: pd.DataFrame) -> pd.DataFrame:
    left, right = [], []
    for _, group in pdf.groupby("grp", sort=False):
        group = group.drop_duplicates("fp").sort_values("fp")
        if len(group) > 1:
            a, b = forest(group)
            left += a
            right += b
    empty = [np.empty(0, np.int64)]
    return pd.DataFrame({"a": np.concatenate(left or empty), "b": np.concatenate(right or empty)})


def _dealt(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """``rows`` with ``(cell, i, j)``: any two rows of a ``grp`` share one, and none weighs much over twice ``most``.

    Small groups are dealt together into cells. A group above ``most`` is cut
    into parts by hash, and each row goes to the cells of its part and every
    other one.
    """
    sizes = cut(rows.groupBy("grp").agg(F.sum(weight).alias("w")).select("grp", "w", F.ceil(F.col("w") / most).cast("int").alias("parts")))
    small = sizes.where("parts = 1").agg(F.sum("w")).first()[0] or 0
    cells = max(1, -(-int(small) // most))
    packed = rows.join(sizes.select("grp", "parts"), "grp").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    meet = F.when(F.col("parts") == 1, F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("mine")))
    cell = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("grp"), F.lit(cells))).otherwise(F.col("grp"))
    return packed.withColumn("other", F.explode(meet)).select(
        *rows.columns, cell.alias("cell"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
    )


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.col("text").cast("binary").alias("text"),
    )


def _prints(slim: DataFrame, shingle: int) -> DataFrame:
    """A row of ``_PRINT`` for each row, written: mark, size, fingerprint and keys of its set."""
    every = max(1, slim.count() // _SAMPLE)
    few = slim.where(F.pmod(F.xxhash64("text_key"), F.lit(every)) == 0).groupBy("text_key").agg(F.first("text").alias("text"))
    common = (
        few.select("text").mapInArrow(partial(_shingle_batches, shingle), "s long")
        .groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(_OFTEN).collect()
    )
    often = np.array([r["s"] for r in common], np.int64).view(np.uint64)
    order = np.argsort(often)
    seen = np.array([r["count"] for r in common], np.int64)[order]
    return stash(slim.mapInArrow(partial(_print_batches, shingle, often[order], seen), _PRINT), "neardup-prints")


def _packed(ranges: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a batch of sets by range of keys: sorted keys, the places of their sets, and the sets' marks."""
    for batch in batches:
        fps, first = np.unique(batch.column(0).to_numpy(), return_index=True)  # copies in a batch go once
        held = batch.column(1).take(pa.array(first))
        sizes = np.diff(held.offsets.to_numpy())
        keys = held.flatten().to_numpy()
        own = np.repeat(np.arange(len(fps), dtype=np.uint32), sizes)
        place = (mix64(keys.view(np.uint64)) >> np.uint64(32)) % np.uint64(ranges)
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(ranges + 1, dtype=np.uint64))
        for r in np.flatnonzero(np.diff(edges)).tolist():
            pick = order[edges[r] : edges[r + 1]]
            used, at = np.unique(own[pick], return_inverse=True)
            width = "u1" if len(used) <= 1 << 8 else "u2" if len(used) <= 1 << 16 else "u4"
            blobs = [keys[pick].tobytes(), at.astype(width).tobytes(), fps[used].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=["r", "keys", "own", "fps"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, fp, many)`` of keys that several sets have; rows come sorted by range."""
    now, keys, fps = None, [], []

    def out() -> Iterator[pa.RecordBatch]:
        k, f = np.concatenate(keys), np.concatenate(fps)
        order = np.lexsort((f, k))
        k, f = k[order], f[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])))
        k, f = k[new], f[new]
        edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(edge, len(k)))
        many = np.repeat(size, size)
        k, f, many = (x[many > 1] for x in (k, f, many))
        for at in range(0, len(k), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65_536]) for x in (k, f, many)], names=["key", "fp", "many"])

    for batch in batches:
        for r, *blobs in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            if now is not None and r != now:
                yield from out()
                keys, fps = [], []
            now = r
            k, f = (np.frombuffer(blobs[i].as_py(), np.int64) for i in (0, 2))
            own = blobs[1].as_py()
            keys.append(k)
            fps.append(f[np.frombuffer(own, f"u{len(own) // len(k)}")])
    if now is not None:
        yield from out()


def pivot_table(nodes: DataFrame) -> DataFrame:
    """Adds ``p``: half the distances of each fingerprint to the pivots, packed in a long."""
    few = nodes.select("s0", "s1", F.xxhash64("fp", F.lit(7)).alias("d")).orderBy("d").limit(_PIVOT_SAMPLE).collect()
    s0, s1 = (np.array([r[c] for r in few], np.int64).view(np.uint64) for c in ("s0", "s1"))
    packed = F.lit(0).cast("long")
    for i, at in enumerate(pivots(s0, s1)):
        far = F.bit_count(F.col("s0").bitwiseXOR(F.lit(few[at]["s0"]))) + F.bit_count(F.col("s1").bitwiseXOR(F.lit(few[at]["s1"])))
        packed = packed.bitwiseOR(F.shiftleft(F.shiftright(far, 1).cast("long"), 8 * i))
    return nodes.withColumn("p", packed)


def candidates(nodes: DataFrame, keys: DataFrame, radius: int = RADIUS, hot: int = 32, block_rows: int = 8192) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly what candidate pairs of ``nodes (fp, n, s0, s1)`` connect.

    ``keys`` are rows ``(fp, keys)``, those of a node once or more. Keys move once, packed by ranges.
    """
    parts = shuffle_partitions(nodes.sparkSession)
    packed = keys.select("fp", "keys").mapInArrow(partial(_packed, 4 * parts), "r int, keys binary, own binary, fps binary")
    shared = packed.repartition(parts, "r").sortWithinPartitions("r").mapInArrow(_shared, "key long, fp long, many long")
    held = stash(shared.join(pivot_table(nodes).select("fp", "n", "s0", "s1", "p"), "fp"), "neardup-keys")
    calm = held.where(F.col("many") <= hot)
    a, b = calm.alias("a"), calm.alias("b")
    alike = (F.col("a.n") * LEAST[1] >= F.col("b.n") * LEAST[0]) & (F.col("b.n") * LEAST[1] >= F.col("a.n") * LEAST[0])
    near = within(F.col("a.p"), F.col("b.p"), (radius + 1) // 2)
    far = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & alike & near & (far <= radius))
    pairs = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()
    busy = held.where(F.col("many") > hot).select(F.col("key").alias("grp"), "fp", "n", "s0", "s1")
    dealt = _dealt(busy, F.lit(1), block_rows)
    forest = dealt.groupBy("cell", "i", "j").applyInPandas(partial(_in_groups, partial(_candidate_forest, radius=radius)), "a long, b long")
    return cut(pairs.union(forest).distinct())


def links(slim: DataFrame, nodes: DataFrame, keys: DataFrame, shingle: int = 5, hot: int = 32, block_rows: int = 8192, block_words: int = 1_000_000) -> DataFrame:
    """Edges ``(a, b)`` over ``fp`` that connect exactly what links connect."""
    grouped = connected_components(candidates(nodes, keys, hot=hot, block_rows=block_rows), "a", "b").select(F.col("id").alias("fp"), F.col("component").alias("grp"))
    members = nodes.join(grouped, "fp").select("fp", "grp", "n", F.col("r.doc_id").alias("_id"), F.col("r.text_key").alias("_key"))
    dealt = _dealt(cut(members), F.col("n"), block_words)
    texts = dealt.join(slim, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    forest = texts.select("grp", "fp", "cell", "i", "j", "text").groupBy("cell", "i", "j")
    return forest.applyInPandas(partial(_in_groups, partial(_link_forest, shingle=shingle)), "a long, b long")


def components(docs: DataFrame, shingle: int = 5, **sizes: int) -> DataFrame:
    """``(doc_id, text_key, root)`` per row of ``docs``: which rows are near copies.

    Word-less and null texts are copies of each other. Ids may be null or
    repeated; an empty table gives no rows; other columns do not matter.
    """
    slim = _slim(docs)
    prints = _prints(slim, shingle)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("r")
    nodes = prints.where("n > 0").groupBy("fp").agg(*[F.first(c).alias(c) for c in ("n", "s0", "s1")], least)
    joined = connected_components(links(slim, stash(nodes, "neardup-nodes"), prints.where("n > 0"), shingle, **sizes), "a", "b")
    named = prints.select("doc_id", "text_key", "fp").join(joined.withColumnRenamed("id", "fp"), "fp", "left")
    return named.select("doc_id", "text_key", F.coalesce("component", "fp").alias("root"))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` with the least ``(doc_id, text_key)`` of each ``root``, null ids last.

    Rows that agree in id and text count as copies, so one of them stays. All
    columns of ``docs`` are kept, whatever their names.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key"))
    stay = found.groupBy("root").agg(least.alias("r")).select(F.col("r.doc_id").alias("stay_id"), F.col("r.text_key").alias("stay_key"))
    stay = cut(stay.distinct())
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    keyed = docs.select(whole, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    kept = keyed.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("key") == F.col("stay_key")), "left_semi")
    same = found.groupBy("doc_id", "text_key").count().where("count > 1")
    if not same.isEmpty():
        kept = kept.dropDuplicates(["id", "key"])
    return kept.select("row.*")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies."""
    return keep_least(docs, cut(components(docs, shingle)))
