"""Parsing, validation, envelopes and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import exprs


def usable_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks with some text."""
    return blocks.where((F.col("type") == "text") & (F.col("text") != ""))


def parse_objects(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``payload`` (variant) for JSON objects; other rows are dropped."""
    parsed = blocks.withColumn("payload", F.try_parse_json(text))
    return parsed.where(F.schema_of_variant("payload").startswith("OBJECT"))


def envelope(rows: DataFrame, payload: Column, source: Column, tenant: Column, event_id: Column, version: Column, plugin: Column | None = None, at: Column | None = None, latency_ms: Column | None = None) -> DataFrame:
    """Raw events: an absent id is drawn anew, an absent time is now, tenant and version have defaults."""
    return rows.select(
        F.coalesce(F.nullif(event_id, F.lit("")), F.uuid()).alias("id") if plugin is not None else F.coalesce(event_id, F.lit("")).alias("id"),
        F.coalesce(source, F.lit("")).alias("source"),
        *([] if plugin is None else [F.coalesce(at, F.current_timestamp()).alias("timestamp"), plugin.alias("plugin_name"), F.coalesce(latency_ms, F.lit(0)).cast("long").alias("ingest_latency_ms")]),
        F.coalesce(tenant, F.lit("default")).alias("tenant_id"),
        exprs.version_or_unknown(version).alias("plugin_version"),
        F.lit("1.0").alias("schema_version"),
        payload.alias("payload"),
    )


def defaulted(envelopes: DataFrame, raw: str = "value") -> DataFrame:
    """Fields of JSON envelopes: defaults where a key is absent; an explicit null or wrong type is a violation.

    Adds ``id, source, tenant_id, payload`` (a string map) and ``type_error``.
    """
    tree = F.try_parse_json(raw)
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    out, wrong = envelopes, F.when(tree.isNull() | ~F.schema_of_variant(tree).startswith("OBJECT"), "envelope must be an object")
    for name, default in (("id", ""), ("source", ""), ("tenant_id", "default")):
        kind = F.schema_of_variant(F.try_variant_get(tree, f"$.{name}", "variant"))
        out = out.withColumn(name, F.when(~F.array_contains(keys, name), F.lit(default)).otherwise(F.when(kind == "STRING", F.try_variant_get(tree, f"$.{name}", "string"))))
        wrong = F.coalesce(wrong, F.when(F.array_contains(keys, name) & (F.coalesce(kind, F.lit("VOID")) != "STRING"), F.lit(f"{name} must be a string")))
    kind = F.schema_of_variant(F.try_variant_get(tree, "$.payload", "variant"))
    wrong = F.coalesce(wrong, F.when(F.array_contains(keys, "payload") & ~F.coalesce(kind, F.lit("VOID")).startswith("OBJECT"), F.lit("payload must be an object")))
    return out.withColumns({"payload": F.from_json(F.get_json_object(raw, "$.payload"), "map<string,string>"), "type_error": wrong})


def validate(rows: DataFrame, payload: str = "payload", source: str | None = None) -> DataFrame:
    """Adds ``errors``, ``valid`` and ``reason`` (label of the first error)."""
    errors = exprs.payload_errors(F.col(payload))
    if source is not None:
        bad = F.struct(F.lit("source").alias("field"), F.lit(exprs.BAD_SOURCE).alias("message"))
        kind = "array<struct<field:string,message:string>>"
        errors = F.concat(F.when(exprs.http_url(F.col(source)), F.array().cast(kind)).otherwise(F.array(bad)), errors)
    return (
        rows.withColumn("errors", errors)
        .withColumn("valid", F.size("errors") == 0)
        .withColumn("reason", F.when(~F.col("valid"), exprs.reject_label(F.col("errors"))))
    )


def quarantine(rows: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with ``error`` and ``error_type``; one plan feeds both."""
    judged = rows.withColumn("error", exprs.first_violation(F.col(payload)))
    bad = judged.where("error is not null").withColumn("error_type", F.lit("SchemaViolation"))
    return judged.where("error is null").drop("error"), bad


def sse_payloads(lines: DataFrame, stream: str = "stream", seq: str = "seq", line: str = "line") -> DataFrame:
    """Server-sent events: ``data:`` lines before a stream's first ``[DONE]`` that hold JSON."""
    data = lines.where(F.col(line).startswith("data:")).withColumn("body", F.trim(F.substr(line, F.lit(6))))
    ends = data.where("body = '[DONE]'").groupBy(stream).agg(F.min(seq).alias("_end"))
    return (
        data.join(ends, stream, "left")
        .where((F.col("_end").isNull() | (F.col(seq) < F.col("_end"))) & F.try_parse_json("body").isNotNull())
        .select(stream, seq, "body")
    )
