"""Connected components by alternating large-star and small-star rounds.

Each round is joins and partial aggregations only, so no neighbour list is
ever collected: a hub with a third of all edges costs rows, not one task's
memory. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return (
        moved.where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node in ``edges``; component = least id.

    Nulls on either side drop the edge, self-loops make a component of one,
    repeated and reversed edges count once, an empty input gives no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select(F.col("a").alias("id"))
    star = cut(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        mark = star.agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("u", "v")).alias("x"),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s"),
        ).first()
        if mark == before or mark["n"] == 0:
            break
        before = mark
        star = cut(_small_star(_large_star(star)))
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    leaves = star.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = star.select(F.col("v").alias("id"), F.col("v").alias("component"))
    alone = loops.select("id", F.col("id").alias("component"))
    return leaves.union(roots).union(alone).groupBy("id").agg(F.min("component").alias("component"))
