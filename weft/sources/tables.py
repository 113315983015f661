"""Parquet tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def list_objects(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths under a folder in ascending order, without reading the files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("created_at")).orderBy("path")


def raw_feed(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A stream of envelopes from Kafka, or from JSON files where ``path`` is given (as in tests)."""
    if "path" in options:
        return spark.readStream.text(options["path"])
    return spark.readStream.format("kafka").options(**options).load().selectExpr("cast(value as string) as value")


def settings_list(value: str | None) -> list[str]:
    """Comma-separated settings without blanks."""
    return [x.strip() for x in (value or "").split(",") if x.strip()]
