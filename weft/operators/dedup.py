"""Content deduplication with a sliding time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, without a time limit."""
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return least.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order])


def sliding_ttl(rows: DataFrame, keys: list[str], ts: str, tie: str, ttl_seconds: int) -> DataFrame:
    """Adds ``is_new``: no row of the key in the ``ttl_seconds`` before; repeats renew the time."""
    run = W.partitionBy(*keys).orderBy(ts, tie)
    at = F.col(ts).cast("timestamp").cast("double")
    gap = at - F.lag(at).over(run)
    return rows.withColumn("is_new", gap.isNull() | (gap > ttl_seconds))


def clusters(rows: DataFrame, keys: list[str], ts: str, ttl_seconds: int) -> DataFrame:
    """Runs of repeats: one row for each with its size, first and last time."""
    timed = rows.withColumn("_ts", F.col(ts).cast("timestamp"))
    return (
        timed.groupBy(*keys, F.session_window("_ts", f"{ttl_seconds} seconds"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .drop("session_window")
    )


def find_similar(seen: DataFrame, tenant: str, source: str) -> DataFrame:
    return seen.where((F.col("tenant_id") == tenant) & (F.col("source") == source))
