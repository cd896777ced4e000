"""Seconds per headline query, as one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the timed runs per query.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from strideframe.session import build_session
from workload import QUERIES

HEADLINE = (
    "sliding_windows", "quality_gate", "basic_stats", "jerk_features", "resample_linear", "spectral_features",
    "axis_correlation", "session_baseline", "feature_frame", "normalize_path_source", "normalize_row_source",
    "normalize_document_source", "sidecar_join", "manifest_validate", "confusion_matrix", "overall_metrics",
    "metrics_by_group", "session_vote", "mode_metric_table", "paired_alignment", "cluster_bootstrap",
    "hierarchical_bootstrap", "group_holdout_split", "stratified_group_kfold", "nested_calibration", "leakage_check",
    "hierarchical_weights", "covered_duration", "duration_balance", "content_digest", "prefix_join", "run_merge",
    "change_detection", "even_sample", "median_impute", "centroid_classifier",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timed("basic_stats")  # starts the JVM's compilers and Python workers
    seconds = {name: round(statistics.median(timed(name) for _ in range(runs)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
