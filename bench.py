"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_topk", "vector_topk", "hybrid_rrf", "diversified_topk", "term_statistics", "jaccard_near_dups", "privacy_redact", "session_rollup", "obs_dedup_window",
    "patterns_cochange", "facet_stats", "graph_khop", "graph_shortest2", "edge_asof", "retention_score", "auto_forget_contradictions", "lww_merge", "frontier", "diagnose", "pricing_summary",
]


def main() -> None:
    from palimpsest.operators.search import release
    from palimpsest.plans import QUERIES
    from palimpsest.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # the session's start is no query's
    took = {}
    for name in HEADLINE:
        release()
        spark.catalog.clearCache()  # no query is helped by what another kept
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
