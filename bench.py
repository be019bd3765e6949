"""Headline timings: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
all).  Every query is run to completion with its whole result written to the
no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "column_profile", "column_roles_lineitem", "column_roles_fast", "table_summary",
    "distinct_counts", "numeric_summary", "time_series_structure_by_key", "clean_table",
    "drop_duplicates", "outlier_rows", "violations", "monthly_trend_lineitem", "top_categories",
    "value_counts", "scatter_points", "correlation_matrix", "chart_batch", "segment_means",
    "kpi_sales", "run_log_read", "report_tables",
)
RUNS = 3


def session(name: str = "bench") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "*")
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from tabwise.plans.queries import all_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    queries = all_queries()
    medians: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        medians[name] = round(statistics.median(times), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(medians.values()), 4),
                "unit": "sec",
                "queries": medians,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
