"""Benchmark: run the headline catalogue queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default: HEADLINE), BENCH_WARMUP (1: warm up on sf0.001 first).
Each query runs to completion through the no-op sink (nothing is collected to the
driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabprobe.plans.catalog import QUERIES  # noqa: E402
from tabprobe.session import local_session  # noqa: E402

HEADLINE = [
    "profile_lineitem", "profile_with_nulls", "profile_top_values", "profile_memory",
    "clean_dedup", "clean_drop_nulls", "clean_fill_median", "clean_fill_mode", "clean_coerce", "clean_pipeline",
    "eda_numeric", "eda_categorical_top", "eda_pearson", "eda_spearman", "eda_outliers_iqr", "eda_outliers_zscore",
    "query_filter", "query_group_multi", "query_batch", "query_project_nonnull",
    "chart_histogram", "chart_bar_mean", "chart_bar_count", "chart_scatter", "export_sample",
    "digest", "quality_flags", "fingerprint", "analyze",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tabprobe-bench")
    # Warm-up (not timed): the same queries on the smallest scale factor next to the
    # benchmark one, so JVM code generation and JIT are not charged to the first query.
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(warm) and os.environ.get("BENCH_WARMUP", "1") == "1":
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf_name = os.path.basename(sf.rstrip("/"))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_name.replace("sf", "") if sf_name.startswith("sf") else sf_name}))


if __name__ == "__main__":
    main()
