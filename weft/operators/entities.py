"""The entity model: checks, accessors and flattened node properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The seven entity lists of an extraction, in their order.
LISTS = ("threat-actor", "malware", "identity", "attack-pattern", "campaign", "indicator", "location")
#: Fixed value: the form of an entity id.
ID_FORM = "^[a-z-]+--[0-9a-f-]{36}$"


def name_of(name: Column) -> Column:
    return F.coalesce(name, F.lit(""))


def aliases_of(aliases: Column) -> Column:
    return F.coalesce(aliases, F.array().cast("array<string>"))


def blocking_text(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(" "), name_of(name))


def violations(entities: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Adds ``violations``: names of the broken checks of an entity, an empty array if it is sound."""
    checks = {
        "id": ~F.coalesce(F.col("id").rlike(ID_FORM), F.lit(False)),
        "stix_type": ~F.coalesce(F.col("stix_type").isin(*LISTS, "relationship"), F.lit(False)),
        "confidence": ~F.coalesce(F.col(confidence).between(0, 100), F.lit(True)),
    }
    return entities.withColumn("violations", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])))


def all_entities(lists: dict[str, DataFrame]) -> DataFrame:
    """One table of all entity lists in their fixed order (``list_no``); columns a list lacks are null."""
    held = [lists[kind].withColumns({"stix_type": F.lit(kind), "list_no": F.lit(i)}) for i, kind in enumerate(LISTS) if kind in lists]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), held)


def _quoted(text: Column) -> Column:
    one = F.to_json(F.array(text))
    return one.substr(F.lit(2), F.length(one) - 2)


def property_text(column: Column, kind: T.DataType) -> Column:
    """A stored property: scalars as they are, times as ISO 8601, anything else as JSON."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.when(column.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(column, _quoted), ", "), F.lit("]")))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column


def flatten(entities: DataFrame) -> DataFrame:
    """Node properties: every column as stored; nulls stay, a list is its JSON text."""
    return entities.select(*[property_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in entities.schema.fields])


def bundle(entities: DataFrame, by: list[str], bundle_id: Column) -> DataFrame:
    """One STIX bundle an export part (``by``), as JSON lines: its id and each object."""
    fields = [c for c in entities.columns if c not in by]
    return entities.select(*by, bundle_id.alias("bundle_id"), F.to_json(F.struct(*fields)).alias("object"))
