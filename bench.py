"""Time the headline queries over whole tables; print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from checks import CHECKS

HEADLINE = [
    "column_profile_lineitem",
    "table_profile",
    "unique_exact",
    "duplicate_exact",
    "describe_numeric",
    "remove_duplicates",
    "fill_mean",
    "fill_median",
    "fill_mode",
    "fill_median_chunk",
    "convert_types",
    "clean_table",
    "csv_typed",
    "stream_profile",
    # Plans with several passes or files.
    "sample_values",
    "row_index",
    "csv_line_breaks",
    "duplicate_exact_by_hash",
    "quality_report_json",
    "stream_batch_fill_many",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("burnish-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        CHECKS[name].query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)  # warm-up
        seconds[name] = round(run(name), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
