"""Records of the topics: raw events, alerts and processed entities, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def raw_event_records(envelopes: DataFrame) -> DataFrame:
    """``(key, value, headers)``: the event id, its JSON and its source."""
    headers = F.array(F.struct(F.lit("source").alias("key"), F.col("source").cast("binary").alias("value")))
    return envelopes.select(F.col("id").cast("string").alias("key"), F.to_json(F.struct(*envelopes.columns)).alias("value"), headers.alias("headers"))


def alert_records(alerts: DataFrame) -> DataFrame:
    """``(key, value)``: alerts keyed by tenant, so each tenant's stay in order."""
    return alerts.select(F.col("tenant_id").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))


def publish(records: DataFrame, options: dict[str, str], checkpoint: str) -> StreamingQuery:
    """Write a stream of records to Kafka, or to JSON files where ``path`` is given (as in tests).

    The query ends when all that is there has been written, so stopping needs no
    deadline: whatever was not written is taken up again from the checkpoint.
    """
    kind = "json" if "path" in options else "kafka"
    out = records if kind == "kafka" else records.withColumn("value", F.col("value").cast("string"))
    return out.writeStream.format(kind).options(**options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed(spark: SparkSession, options: dict[str, str], schema: str) -> DataFrame:
    """Decoded records of a topic from its beginning; records that are no JSON objects have null columns."""
    if "path" in options:
        raw = spark.readStream.text(options["path"])
    else:
        raw = spark.readStream.format("kafka").options(**{"startingOffsets": "earliest", "failOnDataLoss": "false", **options}).load()
    value = F.col("value").cast("string")
    return raw.select(value.alias("value"), F.from_json(value, schema).alias("record")).select("value", "record.*")
