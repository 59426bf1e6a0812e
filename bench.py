"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "aggregate",
    "group_by_sum",
    "group_by_median",
    "trend_month",
    "filled_trend",
    "ranked_groups_top",
    "profile_columns",
    "duplicate_count",
    "dataset_summary",
    "describe",
    "correlations",
    "iqr_outliers",
    "histograms",
    "category_counts",
    "thinned_line",
    "root_cause_contributors",
    "root_cause_comparable_contributors",
    "what_if_segment",
    "recommendations",
    "clean_median",
    "forward_fill_by_group",
    "flatten_json_column",
    "forecast_linear",
    "forecast_holt_winters",
    "classification_logistic",
    "regression_linear",
    "kmeans_sizes",
)


def main() -> None:
    from pyspark.sql import SparkSession

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tablewright.plans.catalog import QUERIES

    wanted = sys.argv[1:] or HEADLINE
    # One small query first, so that the JVM's start is not charged to the first entry.
    QUERIES["trend_month"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
