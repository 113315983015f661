"""Alerts, highlights, briefings, views and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import exprs

#: The first line of a briefing and the line of an empty one.
GREETING = "Good morning. Here is your intelligence briefing."
NOTHING = "No intelligence data available at this time."


def alerts(extractions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Extractions above the threshold, strictly, with a one-line summary."""
    hot = extractions.where(F.col("confidence") > F.lit(threshold))
    return hot.withColumn("summary", F.concat(exprs.counted(F.col("n_entities"), "entity", "entities"), F.lit(" extracted")))


def truncated(text: Column, most: int = 500) -> Column:
    return F.substring(text, 1, most)


def alert_records(extractions: DataFrame, at: Column, threshold: float = 0.5, summary: str | None = None) -> DataFrame:
    """The full alert of each extraction above the threshold.

    ``extractions`` has ``event_id, tenant_id, entity_ids, community_id`` and
    ``confidence``. The id follows from tenant and event, so a batch run again
    gives the same alerts. A text in ``summary`` is cut to 500 characters.
    """
    n = F.coalesce(F.size("entity_ids"), F.lit(0))
    told = F.concat(exprs.counted(n, "entity", "entities"), F.lit(" extracted"))
    return extractions.where(F.col("confidence") > F.lit(threshold)).select(
        F.sha2(F.concat_ws(":", "tenant_id", F.col("event_id").cast("string")), 256).alias("alert_id"),
        "tenant_id", "entity_ids", "community_id",
        (told if summary is None else F.coalesce(F.nullif(truncated(F.col(summary)), F.lit("")), told)).alias("summary"),
        "confidence", at.alias("timestamp"), F.col("event_id").cast("string").alias("source_event_id"),
    )


def room(tenant: Column) -> Column:
    return F.when(tenant.isNotNull() & (tenant != ""), F.concat(F.lit("tenant:"), tenant))


def running_count(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    run = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("alert_count", F.count(F.lit(1)).over(run))


def highlight_active(alerted: DataFrame, probes: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Probes at whose time the key had an alert within the last ``seconds``.

    Times are cut into slots of that length, so the interval join is an
    equality join on key and slot; no key's rows all meet each other.
    """
    at = lambda c: F.col(c).cast("timestamp").cast("double")
    slot = lambda c: F.floor(at(c) / seconds)
    a = alerted.select(F.col(key).alias("_k"), at(ts).alias("_t"), F.explode(F.array(slot(ts), slot(ts) + 1)).alias("_s"))
    held = (F.col("_k") == F.col(key)) & (F.col("_s") == slot(ts)) & (F.col("_t") <= at(ts)) & (at(ts) - F.col("_t") < seconds)
    return probes.join(a, held, "left_semi")


def briefing_items(summaries: DataFrame, tenant: str = "tenant_id", top: int = 10) -> DataFrame:
    """A tenant's first ``top`` summarised communities with their place; a missing id is the place."""
    order = W.partitionBy(tenant).orderBy(F.col("community_id").asc_nulls_last(), "community_summary")
    few = summaries.where("community_summary is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return few.select(tenant, "place", F.coalesce(F.col("community_id").cast("string"), F.col("place").cast("string")).alias("community_id"), "community_summary")


def briefing_script(summaries: DataFrame, tenant: str = "tenant_id", top: int = 5, tenants: DataFrame | None = None) -> DataFrame:
    """One script a tenant from its first ``top`` communities by id; ``tenants`` without any get the empty one."""
    section = F.concat(F.lit("\nSection "), F.col("place").cast("string"), F.lit(" — Community "), F.col("community_id"), F.lit(":\n"), F.col("community_summary"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", section.alias("s")))), lambda x: x["s"])
    scripts = briefing_items(summaries, tenant, top).groupBy(tenant).agg(F.concat_ws("\n", F.lit(GREETING), F.array_join(lines, "\n")).alias("script"))
    if tenants is None:
        return scripts
    return tenants.select(tenant).distinct().join(scripts, tenant, "left").select(tenant, F.coalesce("script", F.lit(NOTHING)).alias("script"))


def object_key(prefix: str, tenant: Column, day: Column, ident: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix), tenant, F.date_format(day, "yyyy-MM-dd"), F.concat(ident, F.lit(".mp3")))


def latest_object(objects: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """Each tenant's last object in the order of keys."""
    return objects.groupBy(tenant).agg(F.max("object_key").alias("object_key"))


def histogram(values: DataFrame, value: str, bounds: tuple, keys: list[str] | None = None) -> DataFrame:
    """Cumulative counts by upper bound, ``+Inf`` last."""
    labels = [*[str(float(b)) for b in bounds], "+Inf"]
    counts = [F.count(F.when(F.col(value) <= F.lit(float(b)), 1)) for b in bounds] + [F.count(F.lit(1))]  # a sum over no rows is null
    wide = values.groupBy(*(keys or [])).agg(F.array(*[F.struct(F.lit(n).alias("le"), c.alias("n")) for n, c in zip(labels, counts)]).alias("_h"))
    return wide.select(*(keys or []), F.explode("_h").alias("_b")).select(*(keys or []), "_b.le", "_b.n")


def counters(rows: DataFrame, labels: list[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def gauges(rows: DataFrame, labels: list[str], value: str, ts: list[str]) -> DataFrame:
    """The last value of each gauge."""
    return rows.groupBy(*labels).agg(F.max_by(value, F.struct(*ts)).alias("value"))


def observed(rows: DataFrame, name: str = "metrics") -> tuple[DataFrame, Observation]:
    """``rows`` as they are, and an observation that holds their number once they have been used."""
    told = Observation(name)
    return rows.observe(told, F.count(F.lit(1)).alias("rows")), told
