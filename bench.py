"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR is the data folder, BENCH_CPUS the local cores.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowaudit.plans import catalog  # noqa: E402
from flowaudit.session import local_session  # noqa: E402

HEADLINE = [
    "counts_by_threshold", "views_counts", "ppv_reachability", "alert_term", "detection_metrics", "rank_metrics", "ece",
    "telemetry_sessions", "window_features", "window_join", "counter_rates", "active_flows", "flow_features", "nearest_in_time",
    "shared_space_zeek", "conflict_ceiling", "pair_conflicts_between_files", "grouping_alignment", "split_random", "split_group",
    "wasserstein", "domain_auc", "cluster_bootstrap", "kendall_tau", "latency_quantile_ci", "temperature", "nn_probe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle=max(int(cpus), 1), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()           # start the JVM's readers
    took = {}
    for n in names:
        t = time.perf_counter()
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
