"""Time the headline queries and print one JSON line.

Each query is run once to warm up, then timed; the value is the sum of the medians.
``BENCH_SF_DIR``, ``BENCH_CPUS``, ``BENCH_RUNS`` and ``BENCH_QUERIES`` change the defaults.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from fleet_audit.plans import registered
from fleet_audit.session import local_session

HEADLINE = (
    "all_findings", "query_reports", "query_report", "detect_no_partition_pruning", "detect_exploding_join",
    "detect_bad_broadcast", "detect_missing_stats", "detect_skew", "detect_small_files", "detect_spilling",
    "detect_not_the_querys_fault", "detect_ineffective_dynamic_filter", "tasks_of_skewed_stages", "latest_snapshot",
    "flatten_query_operators", "estimate_scan", "partition_info", "table_stats_lineitem", "table_stats_documents",
    "properties_entries", "normalize_values", "run_rules", "all_config_findings", "diff_clusters", "enrich",
    "config_detail", "resolve_scope", "search_recommendations", "ingest_snapshots_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in names:
        taken = []
        for attempt in range(runs + 1):
            started = time.perf_counter()
            registered.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name}: {[round(t, 2) for t in taken]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
