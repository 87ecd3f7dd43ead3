"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the threads."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lakequill import catalogue

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "pricing_summary", "filter_predicates", "integer_division", "inner_join", "left_join_is_null", "multiway_join", "shipping_priority", "group_basic", "count_forms", "group_concat",
    "having_aggregate", "first_row_bare", "semi_exists", "anti_not_in", "correlated_scalar", "correlated_theta", "cte_chain", "recursive_count", "recursive_union", "top_k",
    "distinct_rows", "union_distinct", "intersect", "window_functions", "text_functions", "date_functions", "insert_select", "update_rows",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    for name in HEADLINES:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": FOLDER.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
