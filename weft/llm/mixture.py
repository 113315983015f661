"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's words, its documents in seeded order, are cut into blocks of ``WIDTH``
words (the last may be shorter). Blocks are the seats: they go to sources by the
highest quotients target / (2 seats + 1), shard by shard (the method never takes
back a seat when the house grows, so a shard's quotas are the difference of two
apportionments). A source's seats are filled with consecutive blocks, round and
round from a seeded one on. Since documents stand in seeded order that is a random
choice of documents, and only the two at the ends of a round are cut: every text
of the mix is a document or one contiguous span of it.

Rows are never joined: a row's place in its source is found on the row itself,
after one range shuffle, so repeated rows, null ids and clashing names are rows
like others.

Only one row a source reaches the driver; the number of sources is checked
against ``max_sources``.
"""

from __future__ import annotations

import heapq

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.text import GAPS
from weft.session import cut, shuffle_partitions, stash

SEED = 20_240_601
SHARDS = 16
WIDTH = 16


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, GAPS), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def apportion(claims: list[float], seats: int) -> list[int]:
    """Sainte-Lague: ``seats`` to the highest quotients claim / (2 n + 1); ties to the first."""
    live = [i for i, c in enumerate(claims) if c > 0]
    got = [0] * len(claims)
    if not live or seats <= 0:
        return got
    low, high = 0.0, 2.0 * max(claims)
    for _ in range(200):  # seats above a quotient q: floor(claim / (2 q) + 1 / 2)
        mid = (low + high) / 2
        if sum(int(claims[i] / (2 * mid) + 0.5) for i in live) > seats:
            low = mid
        else:
            high = mid
    for i in live:
        got[i] = int(claims[i] / (2 * high) + 0.5)
    heap = [(-claims[i] / (2 * got[i] + 1), i) for i in live]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-claims[i] / (2 * got[i] + 1), i))
    return got


def shard_quotas(claims: list[float], seats: int, shards: int) -> list[list[int]]:
    """Seats of each source in each shard; shards have equal houses to within one seat."""
    grown = [apportion(claims, seats * k // shards) for k in range(shards + 1)]
    return [[b - a for a, b in zip(x, y)] for x, y in zip(grown, grown[1:])]


_SOURCE = "source string, source_size long, target double, blocks long, first long, quota long, shard_ends array<long>"


def _placed(rows: DataFrame, seed: int, shards: int, width: int, max_sources: int) -> DataFrame:
    """``rows (row, source, size, draw, tie)``, range-dealt and written, with their place and their source's plan.

    Adds ``part, start, source_size, target`` and the columns of the plan.
    """
    spark = rows.sparkSession
    per_part = cut(rows.groupBy("part", "source").agg(F.sum("size").alias("size")))
    sums = per_part.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found = sorted(((r["source"], r["size"]) for r in sums), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in found]
    goal = targets(sizes, [1.0 + i % 3 for i in range(len(found))])
    claims = [g / width for g in goal]
    grown = [apportion(claims, round(sum(claims)) * k // shards) for k in range(1, shards + 1)]
    entries = []
    for i, (source, n) in enumerate(found):
        blocks = max(1, -(-n // width))
        ends = [min(seats[i], 3 * blocks) for seats in grown]
        first = xxhash.xxh64_intdigest(repr(source), seed) % blocks
        entries.append((source, n, goal[i], blocks, first, ends[-1], ends))
    table = spark.createDataFrame(entries, _SOURCE)
    # one row a source and partition: sums of a source's earlier partitions
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(F.col("part").alias("op"), F.col("source").alias("os"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("part", "source").orderBy("draw", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = rows.withColumn("upto", F.sum("size").over(inside)).join(
        F.broadcast(offsets.join(table.withColumnRenamed("source", "ts"), F.col("os").eqNullSafe(F.col("ts")))),
        (F.col("part") == F.col("op")) & F.col("source").eqNullSafe(F.col("os")),
    )  # one entry a source and partition it has rows in: at most partitions plus sources
    return at.withColumn("start", F.col("offset") + F.col("upto") - F.col("size")).drop("op", "os", "ts", "upto", "offset")


def _dealt(rows: DataFrame) -> DataFrame:
    """Range-dealt by source and draw. Rows alike in all are told apart by ``tie``, which only orders them."""
    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartitionByRange(parts, "source", "draw", "tie").withColumn("part", F.spark_partition_id())


def _draw(seed: int) -> list[Column]:
    """The seeded order of a source's rows."""
    return [F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("draw"), F.xxhash64(F.monotonically_increasing_id()).alias("tie")]


def _arcs(width: int) -> list[tuple[Column, Column]]:
    """The words of the last, partial round: up to the source's end, and on from its start."""
    more, last = F.col("quota") % F.col("blocks"), F.col("first") + F.col("quota") % F.col("blocks")
    ahead = F.least(F.col("source_size"), last * width)
    return [(F.when(more > 0, F.col("first") * width).otherwise(ahead), ahead), (F.lit(0).cast("long"), F.greatest(F.lit(0), last - F.col("blocks")) * width)]


def _spans(width: int) -> Column:
    """Array of ``(low, high, shard)``: the stretches of a row's words that the mix takes, a round each."""
    start, end, rounds = F.col("start"), F.col("start") + F.col("size"), F.floor(F.col("quota") / F.col("blocks"))

    def shard(word: Column, turn: Column) -> Column:
        seat = turn * F.col("blocks") + F.pmod(F.floor(word / width) - F.col("first"), F.col("blocks"))
        return F.size(F.filter("shard_ends", lambda e: e <= seat)).cast("int")

    def span(low: Column, high: Column, turn: Column) -> Column:
        return F.struct((low - start).alias("low"), (high - start).alias("high"), shard(low, turn).alias("shard"))

    whole = F.transform(F.sequence(F.lit(1).cast("long"), rounds), lambda t: span(start, end, t - 1))
    whole = F.when(rounds > 0, whole).otherwise(F.array().cast("array<struct<low:bigint,high:bigint,shard:int>>"))
    parts = [span(F.greatest(start, lo), F.least(end, hi), rounds) for lo, hi in _arcs(width)]
    return F.filter(F.concat(whole, F.array(*parts)), lambda x: x["high"] > x["low"])


def mix(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, width: int = WIDTH, max_sources: int = 1_000_000) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, shard)`` for every row of ``docs``.

    ``shard`` is the least that takes some of the row (null: none does).
    Sources are taken in code point order, null last, and weigh 1, 2, 3,
    repeating. Null texts have size 0 and are never taken; a null source is a
    source of its own; rows with a repeated ``doc_id``, or alike in all, are mixed
    each for itself; an empty table gives no rows; other columns do not matter.
    """
    sized = stash(
        docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "source", word_count(F.col("text")).alias("size"), *_draw(seed)),
        "mixture-sizes",
    )
    placed = _placed(stash(_dealt(sized), "mixture-dealt"), seed, shards, width, max_sources).withColumn("spans", _spans(width))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return placed.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_min(F.transform("spans", lambda s: s["shard"])).alias("shard"))


def take(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, width: int = WIDTH, max_sources: int = 1_000_000, shard_as: str | None = None) -> DataFrame:
    """The mix itself: a row of ``docs`` for every stretch of its words that ``mix`` takes.

    Columns are those of ``docs``, whatever their names, and the shard under the
    name ``shard_as`` if given. A row taken whole keeps its text unchanged; of the
    rows at the ends of a round a contiguous span of words is taken, joined by
    one space, and ``n_chars`` (if there) is set anew. Odd rows are treated as
    ``mix`` does.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    # sizes are counted after the shuffle: the sampling of its ranges would count them once more
    dealt = _dealt(docs.select(whole, "source", *_draw(seed))).withColumn("size", word_count(F.col("row").getField("text")))
    placed = _placed(stash(dealt, "mixture-rows"), seed, shards, width, max_sources)
    rows = placed.select("row", "size", F.explode(_spans(width)).alias("span"))
    part = F.col("span.high") - F.col("span.low") < F.col("size")
    words = F.filter(F.split(F.col("row").getField("text"), GAPS), lambda w: w != "")
    piece = F.array_join(F.slice(words, (F.col("span.low") + 1).cast("int"), (F.col("span.high") - F.col("span.low")).cast("int")), " ")
    rows = rows.withColumn("piece", F.when(part, piece))
    out = []
    for field in docs.schema.fields:
        value = F.col("row").getField(field.name)
        if field.name == "text":
            value = F.coalesce("piece", value)
        elif field.name == "n_chars":
            value = F.when(part, F.length("piece").cast(field.dataType)).otherwise(value)
        out.append(value.alias(field.name))
    return rows.select(*out, *([F.col("span.shard").alias(shard_as)] if shard_as else []))
