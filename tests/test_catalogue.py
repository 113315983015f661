"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from weft.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = [
    "validate_errors", "dlq_split", "validate_source_url", "sse_decode", "dedup_first", "dedup_sliding_ttl", "dedup_clusters",
    "confidence_histogram", "alerts_above_threshold", "highlight_active", "vector_tier", "alias_match", "cooccurrence_tier",
    "resolution_decision", "node_upsert", "edge_upsert", "khop_2", "connected_components", "briefing_script", "latest_object",
    "vector_topk_tenants", "name_jaccard", "all_entities", "entity_nodes", "entity_texts", "entity_violations", "stix_bundle",
    "envelope_full", "envelope_keys", "text_truthy", "alert_records", "gauges", "raw_event_records", "plugin_blocks", "tool_registry",
    "stream_dedup", "tenant_components", "tenant_khop", "tenant_edges", "communities_fallback", "resolved_nodes", "vector_upsert",
    "summary_search", "briefing_items", "geo_distance", "usable_blocks",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float) and not math.isinf(v):
        v = round(v, 5)
        return int(v) if v.is_integer() else v
    return int(v) if isinstance(v, bool) else v


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(map(_norm, r)) for r in df[cols].astype(object).itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert _rows(got) == _rows(duck.execute(catalogue.oracle_sql()[name]).fetchdf())


def test_every_query_but_named_ones_has_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"hash_embedding", "graph_view_fixture", "phonetic_blocks"}
