"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is written to the ``noop`` sink (the whole result is computed,
nothing is collected); one warm-up run, then the median of
$BENCH_REPEATS runs.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabsense.plans import catalog  # noqa: E402
from tabsense.session import local_session  # noqa: E402

HEADLINE = [
    "quality_scorecard", "overview", "missing_report", "drop_duplicates", "impute_median",
    "impute_ffill", "impute_mode", "cap_iqr", "remove_outliers", "outlier_report", "clean_table",
    "cleaning_preview", "profile_numeric", "profile_categorical", "describe_numeric",
    "top_correlations", "frequency_table", "histogram", "box_stats", "time_series",
    "classification_metrics", "regression_metrics", "confusion_matrix", "recommendation",
    "train_test_split", "scale_standard",
    # added after the first round: backward and hot-key fills, split, balancing, training, CSV and report
    "impute_bfill", "impute_bfill_hot_key", "stratified_split", "smote_rows", "linear_one_feature", "csv_quoted_roundtrip", "report_frame",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          app="tabsense-bench")
    qs = catalog.queries()
    names = [n for n in (only or HEADLINE) if n in qs]
    times = {}
    for name in names:
        fn = qs[name]
        runs = []
        for i in range(repeats + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                runs.append(dt)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "median_seconds_per_query_sum", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
