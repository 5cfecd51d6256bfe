"""Times how long the nodes take to be derived and written, and then each headline query; prints one JSON line.

The same code runs once on the smallest tables first, so that code is compiled; nothing
that is timed is kept from there.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from dirgauge.plans.registry import QUERIES
from dirgauge.sources import tables

HEADLINE = ["tree_paths", "summary_grouping_sets", "size_histogram_by_user", "smallfiles_rollup", "smallfiles_hotspots", "userusage_top", "paths_csv_rows", "child_counts"]
WARM_UP = "/root/testdata/sf0.001"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    if os.path.isdir(WARM_UP):
        run(QUERIES["summary_overall"](spark, WARM_UP))
    began = time.perf_counter()
    tables.nodes(spark, sf_dir)
    took = {"load_nodes": round(time.perf_counter() - began, 3)}
    for name in HEADLINE:
        began = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
