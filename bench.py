"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of parquet tables (default sf0.1). BENCH_CPUS: local cores (default 8).
Every query is executed in full into the no-op sink, twice; the better time counts, since the
first run of a plan mostly measures the JVM compiling it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from panelrank.queries import spark_queries
from panelrank.session import local_session

HEADLINE = [
    "daily_rollup",
    "resample_6h",
    "calendar_fill",
    "iqr_filter",
    "interpolate_linear",
    "gap_lengths",
    "impute_knn",
    "rolling_features",
    "rolling_median",
    "ema",
    "momentum",
    "rmssd",
    "instance_table",
    "build_instances",
    "variable_stats",
    "column_profile",
    "correlation_pairs",
    "acf",
    "within_group_features",
    "smoothed_priors",
    "oof_priors",
    "oof_priors_pair",
    "ranking_features",
    "ndcg_at_5",
    "top_k_per_group",
    "segment_metrics",
    "lambda_sweep",
    "blend_sweep",
    "classification_report",
    "threshold_sweep",
    "bootstrap_ci",
    "wilcoxon",
    "taxonomy_rules",
    "nearest_rows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    queries = spark_queries()
    queries["daily_rollup"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of the better of two runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
