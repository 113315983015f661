"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that count as content of a payload.
CONTENT_KEYS = ("text", "content", "data", "url")
#: Messages of broken rules.
BLANK = "must not be None or empty string"
EMPTY = "payload must not be empty"
LACKING = "must contain at least one of: text, content, data, url"
BAD_SOURCE = "source must be a valid HTTP URL"
#: Display colours by entity type, and the default.
COLOURS = {
    "threat-actor": "#ef4444",
    "malware": "#f97316",
    "attack-pattern": "#eab308",
    "campaign": "#a855f7",
    "identity": "#3b82f6",
    "tool": "#06b6d4",
    "location": "#10b981",
    "vulnerability": "#f43f5e",
}
DEFAULT_COLOUR = "#6366f1"
#: Histogram bounds.
CONFIDENCE_BOUNDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
SIZE_BOUNDS = (1, 2, 5, 10, 20, 50, 100, 500)


def pascal_label(kind: Column) -> Column:
    """``threat-actor`` to ``ThreatActor``: each part's first letter upper, the rest lower."""
    parts = F.transform(F.split(kind, "-"), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(t.substr(F.lit(2), F.length(t)))))
    return F.array_join(parts, "")


def edge_type(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"))


def safe_label(text: Column) -> Column:
    """Only letters, digits and underscores; ``L_`` before a leading digit."""
    clean = F.regexp_replace(text, "[^a-zA-Z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("L_"), clean)).otherwise(clean)


def point_id(entity_id: Column) -> Column:
    """What follows the first ``--``, or the whole id."""
    return F.when(F.instr(entity_id, "--") > 0, F.element_at(F.split(entity_id, "--", 2), 2)).otherwise(entity_id)


def version_or_unknown(version: Column) -> Column:
    return F.coalesce(F.nullif(version, F.lit("")), F.lit("unknown"))


def pick_text(*choices: Column) -> Column:
    """The first choice that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def truthy_text(raw: Column, *keys: str) -> Column:
    """The first key of a JSON object whose value is not null, empty, zero or false, as text; else the empty string."""
    tree = F.try_parse_json(raw)
    found = []
    for key in keys:
        value = F.try_variant_get(tree, f"$.{key}", "string")
        kind = F.schema_of_variant(F.try_variant_get(tree, f"$.{key}", "variant"))
        number = F.try_variant_get(tree, f"$.{key}", "double")
        falsy = value.isNull() | value.isin("", "[]", "{}") | ((kind != "STRING") & (kind != "BOOLEAN") & (F.coalesce(number, F.lit(1.0)) == 0)) | ((kind == "BOOLEAN") & (value == "false"))
        found.append(F.when(~falsy, F.when(kind == "BOOLEAN", "True").otherwise(value)))
    return F.coalesce(*found, F.lit(""))


def http_url(source: Column) -> Column:
    """True for http and https URLs with a host."""
    return (
        F.coalesce(F.try_parse_url(source, F.lit("PROTOCOL")), F.lit("")).isin("http", "https")
        & F.try_parse_url(source, F.lit("HOST")).isNotNull()
    )


def url_path_key(url: Column) -> Column:
    return F.ltrim(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))


def _blank_keys(payload: Column) -> Column:
    """Keys with a null or empty value, in the payload's order."""
    return F.transform(F.filter(F.map_entries(payload), lambda e: e["value"].isNull() | (e["value"] == "")), lambda e: e["key"])


def payload_errors(payload: Column) -> Column:
    """All errors of a ``map<string,string>`` payload, as ``array<struct<field, message>>``."""
    err = lambda f, m: F.struct(f.alias("field"), m.alias("message"))
    blank = _blank_keys(payload)
    by_key = F.transform(blank, lambda k: err(F.concat(F.lit("payload."), k), F.lit(f"value {BLANK}")))
    lacking = F.when(
        ~F.arrays_overlap(F.map_keys(payload), F.array(*[F.lit(k) for k in CONTENT_KEYS])),
        F.array(err(F.lit("payload"), F.lit(LACKING))),
    ).otherwise(F.array().cast("array<struct<field:string,message:string>>"))
    empty = F.array(err(F.lit("payload"), F.lit(EMPTY)))
    return F.when(F.coalesce(F.size(payload), F.lit(0)) <= 0, empty).otherwise(F.concat(by_key, lacking))


def first_violation(payload: Column) -> Column:
    """The first broken rule of an envelope's payload, in its order; null if none."""
    blank = _blank_keys(payload)
    return (
        F.when(F.coalesce(F.size(payload), F.lit(0)) <= 0, EMPTY)
        .when(~F.arrays_overlap(F.map_keys(payload), F.array(*[F.lit(k) for k in CONTENT_KEYS])), f"payload {LACKING}")
        .when(F.size(blank) > 0, F.concat(F.lit("payload."), F.get(blank, F.lit(0)), F.lit(f" {BLANK}")))
    )


def reject_label(errors: Column) -> Column:
    first = F.get(errors, F.lit(0))
    return F.coalesce(F.concat_ws(":", first["field"], first["message"]), F.lit("schema_violation"))


def confidence(total: Column, kinds: Column) -> Column:
    """Extraction confidence from the number of entities and of entity types."""
    raw = F.lit(0.1) * total + F.lit(0.05) * kinds
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), raw))


def tier(score: Column, merge: float = 0.95, review: float = 0.50) -> Column:
    return F.when(score >= merge, "auto_merge").when(score >= review, "ambiguous").otherwise("new_entity")


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def colour(kind: Column, given: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(table[kind], *([given] if given is not None else []), F.lit(DEFAULT_COLOUR))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    # binding the norm through a one-element array keeps it from being evaluated for each element
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def url_encoded(text: Column) -> Column:
    return F.url_encode(text)


def backoff_seconds(attempt: int, base: float = 0.5, cap: float = 60.0) -> float:
    """Wait after a failed attempt, counted from 0."""
    return min(cap, base * 2**attempt)
