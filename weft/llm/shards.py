"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in a shard drawn
from its id; in each round a document of a linked group asks to move to the
shard that holds most of its group, and asks are granted by quotas on the bytes
that may flow from shard to shard, so that no shard passes its capacity.

Documents of one group and one draw always move together, so rounds join and sum
the table of groups by draws, with at most ``SHARDS * DRAWS`` rows a group.
Documents meet it twice: in the sum that makes it, combined before the shuffle,
and in the join that brings their shards, on group and draw, which deals a hot
group over as many keys. A group larger than half a shard is beforehand split by
draws into parts that fit, so it is never one label.

Groups of at least ``1 / LARGE`` of a shard are seated first, largest first, and
stay. A tie goes to the shard with most room, then by a hash of the group. Grants
are drawn by group and can pass the capacity: a shard that does gives groups up
again. Groups given up, and those still split after the rounds, are dealt whole.

Unlinked documents have no neighbour to follow. They are dealt last with those
groups, in buckets of hashed ids or groups, always to the shard with the fewest
bytes, which evens sizes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.session import cut, shuffle_partitions

SHARDS = 16
ROUNDS = 4
DRAWS = 4
BUCKETS = 65_536
LARGE = 64
CELLS = 4096
_GRID = 1_000_000


def _draw(round_no: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(round_no), *cols), F.lit(_GRID))


def quotas(asked: dict[tuple[int, int], int], loads: list[int], capacity: float) -> dict[tuple[int, int], float]:
    """Share of each flow ``(from, to)`` to grant so that no shard passes ``capacity``.

    A shard takes in what its room allows, and as much again as leaves it; the
    leavers' own grants are settled by a few passes from the largest demand down.
    """
    share = {flow: 1.0 for flow in asked}
    for _ in range(20):
        changed = False
        for shard in range(len(loads)):
            into = sum(n * share[f] for f, n in asked.items() if f[1] == shard)
            out = sum(n * share[f] for f, n in asked.items() if f[0] == shard)
            room = capacity - loads[shard] + out
            if into > max(room, 0.0) * (1 + 1e-9):
                cutback = max(room, 0.0) / into
                for f in asked:
                    if f[1] == shard:
                        share[f] *= cutback
                changed = True
        if not changed:
            break
    return share


def deal(buckets: list[tuple[int, int]], loads: list[int]) -> list[tuple[int, int]]:
    """``(bucket, shard)``: largest bucket first, to the shard with the fewest bytes."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size, bucket in sorted(((n, b) for b, n in buckets), reverse=True):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append((bucket, shard))
    return out


def _loads(rows: DataFrame, shards: int) -> list[int]:
    """Bytes in each shard: ``shards`` numbers, whatever the input."""
    found = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    return [int(found.get(i, 0)) for i in range(shards)]


def propagate(linked: DataFrame, shards: int, capacity: float, rounds: int) -> DataFrame:
    """Labels of linked parts ``(copy, start, size, link, shard)`` after ``rounds`` rounds."""
    for turn in range(rounds):
        loads = _loads(linked, shards)
        room = F.array(*[F.lit(int(capacity) - n) for n in loads])[F.col("shard")]
        held = linked.groupBy("link", "shard").agg(F.sum("size").alias("n"))
        rank = F.struct("n", room.alias("room"), F.xxhash64("link", "shard").alias("tie"), F.col("shard").alias("s"))
        best = held.groupBy("link").agg(F.max(rank).alias("b")).select("link", F.col("b.s").alias("wish"))
        asking = cut(linked.join(best, "link"))
        flows = asking.where("wish <> shard").groupBy("shard", "wish").agg(F.sum("size").alias("n")).collect()
        asked = {(r["shard"], r["wish"]): int(r["n"]) for r in flows}
        if not asked:
            break
        share = quotas(asked, loads, capacity)
        grant = F.create_map(*[x for (a, b), v in share.items() for x in (F.lit(a * shards + b), F.lit(int(v * _GRID)))])
        # all of a group's parts in one shard move or stay together
        move = (F.col("wish") != F.col("shard")) & (_draw(turn + 1, "link", "shard") < grant[F.col("shard") * shards + F.col("wish")])
        linked = cut(asking.withColumn("shard", F.when(F.coalesce(move, F.lit(False)), F.col("wish")).otherwise(F.col("shard"))).drop("wish"))
    return linked


def seat_large(linked: DataFrame, shards: int, capacity: float) -> DataFrame:
    """Labels with every link of at least ``1 / LARGE`` of a shard whole in one shard."""
    # at most ``shards * LARGE`` links are so large
    large = linked.groupBy("link").agg(F.sum("size").alias("n")).where(F.col("n") >= max(capacity, 1.0) / LARGE).collect()
    seats = deal([(r["link"], int(r["n"])) for r in large], [0] * shards)
    seats = linked.sparkSession.createDataFrame(seats, "link long, seat int")
    return linked.join(F.broadcast(seats), "link", "left").withColumn("shard", F.coalesce("seat", "shard")).drop("seat")


def settle(linked: DataFrame, shards: int, capacity: float) -> DataFrame:
    """``(link, home, size)``: the one shard a link is whole in, or null if it must be dealt anew.

    That is so if it is still split, or is given up by a shard over its capacity.
    """
    whole = linked.groupBy("link").agg(F.min("shard").alias("home"), F.max("shard").alias("last"), F.sum("size").alias("size"))
    whole = cut(whole.select("link", F.when(F.col("home") == F.col("last"), F.col("home")).alias("home"), "size"))
    loads = _loads(whole.select(F.col("home").alias("shard"), "size"), shards)
    if max(loads) <= capacity:
        return whole
    cell = F.pmod(F.xxhash64(F.lit("cell"), "link"), F.lit(CELLS))
    small = whole.where((F.col("size") < max(capacity, 1.0) / LARGE) & F.col("home").isNotNull())
    # at most ``shards * CELLS`` sums
    cells = {(r["home"], r["cell"]): r["n"] for r in small.groupBy("home", cell.alias("cell")).agg(F.sum("size").alias("n")).collect()}
    below = [0] * shards
    for shard in range(shards):
        while loads[shard] > capacity and below[shard] < CELLS:
            loads[shard] -= int(cells.get((shard, below[shard]), 0))
            below[shard] += 1
    leave = (F.col("size") < max(capacity, 1.0) / LARGE) & (cell < F.array(*map(F.lit, below))[F.col("home")])
    return whole.withColumn("home", F.when(~F.coalesce(leave, F.lit(False)), F.col("home")))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, text_key)`` for every row.

    The law is ``bytes``: shards' sums of sizes (UTF-8 bytes of the text plus
    one) come out nearly equal, and equal texts share a shard unless their group
    is larger than half a shard. Null texts are empty; rows with a null or
    repeated ``doc_id`` are rows like others; an empty table gives no rows; other
    columns do not matter. Slots number a shard's rows from 0 without gaps.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("text").alias("text_key"),
        F.xxhash64(text).alias("_h"),
    )
    draws = shards * DRAWS
    rows = cut(
        rows.withColumn("copy", F.xxhash64("_h", "text_crc32", "size"))
        .withColumn("start", F.pmod(F.xxhash64(F.lit("start"), "doc_id"), F.lit(draws)).cast("int"))
        .drop("_h")
    )
    total = int(rows.agg(F.sum("size").alias("n")).first()["n"] or 0)
    capacity = total / shards
    state = rows.groupBy("copy", "start").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("size"))
    group = W.partitionBy("copy")  # at most ``draws`` rows a group, however many its documents
    state = state.select("*", F.sum("size").over(group).alias("bytes"), F.sum("members").over(group).alias("copies")).where("copies > 1")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("bytes") / (max(capacity, 1.0) / 2)))
    label = F.when(pieces > 1, F.xxhash64("copy", F.floor(F.col("start") * pieces / draws))).otherwise(F.col("copy"))
    linked = cut(state.select("copy", "start", "size", label.alias("link"), F.pmod("start", F.lit(shards)).cast("int").alias("shard")))
    linked = propagate(cut(seat_large(linked, shards, capacity)), shards, capacity, rounds)
    home = cut(settle(linked, shards, capacity))
    loads = _loads(home.select(F.col("home").alias("shard"), "size"), shards)
    group_bucket = F.when(F.col("home").isNull(), F.pmod(F.xxhash64("link"), F.lit(buckets)) + buckets).cast("int")
    linked = linked.select("copy", "start", "link").join(home, "link").select("copy", "start", F.col("home").alias("shard"), group_bucket.alias("dealt"))
    bucket = F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int")
    rows = cut(rows.join(linked, ["copy", "start"], "left").withColumn("bucket", F.when(F.col("shard").isNull(), F.coalesce("dealt", bucket))))
    sums = [(r["bucket"], int(r["n"])) for r in rows.where("bucket is not null").groupBy("bucket").agg(F.sum("size").alias("n")).collect()]
    # one entry a bucket, so at most twice ``buckets`` entries
    seats = spark.createDataFrame(deal(sums, loads), "bucket int, seat int")
    placed = rows.join(F.broadcast(seats), "bucket", "left").select(
        "doc_id", "size", "text_crc32", "text_key", F.coalesce("shard", "seat").alias("shard")
    )
    return number(placed, spark).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "text_key"
    )


def number(placed: DataFrame, spark: object) -> DataFrame:
    """Adds ``slot``: each row's place in its shard, without one task a shard.

    Rows are dealt by ranges of shard and id; a row's slot is its place in its
    range plus the shard's rows in earlier ranges.
    """
    dealt = cut(
        placed.repartitionByRange(shuffle_partitions(spark), "shard", "doc_id", "text_key").withColumn("part", F.spark_partition_id())
    )
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "part").orderBy("doc_id", "text_key")
    return (
        dealt.withColumn("at", F.row_number().over(inside))
        .join(offsets, ["shard", "part"])
        .withColumn("slot", (F.col("offset") + F.col("at") - 1).cast("long"))
        .drop("part", "at", "offset")
    )
