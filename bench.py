"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from weft.plans import catalogue
from weft.session import local_session

HEADLINE = [
    "envelope_defaults", "validate_errors", "dlq_split", "content_hash", "dedup_first", "dedup_sliding_ttl", "dedup_clusters",
    "confidence_histogram", "alerts_above_threshold", "highlight_active", "vector_topk", "name_match", "cooccurrence",
    "resolution_decision", "node_upsert", "edge_upsert", "connected_components", "community_context", "briefing_script",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 16)
    queries = catalogue.queries()
    queries["dedup_first"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
