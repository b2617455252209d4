"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from factloom.queries import QUERIES
from factloom.session import local_session

HEADLINE = [
    "log_report_scalars", "log_sessions", "log_retry_bursts", "search_plain", "search_context", "hotspots", "violations_by_rule", "gate_score", "compound_relaxed_limit", "metrics_rollup", "folder_slices_upper_median",
    "clone_pairs", "clone_clusters", "structural_cosine", "find_references_depth2", "dependency_edges", "type_closure_footprint", "dead_symbols", "changed_symbols_interval", "baseline_diff",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["log_calls_per_tool"](spark, sf_dir).count()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
