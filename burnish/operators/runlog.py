"""The log of cleaning runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import HISTORY_ROWS

RUN_SCHEMA = "id string, filename string, upload_date timestamp, status string, rows_processed bigint, file_size bigint"
STATUSES = ("completed", "failed")


def append_run(
    spark: SparkSession,
    path: str,
    *,
    id: str,
    filename: str,
    status: str,
    rows_processed: int | None = None,
    file_size: int | None = None,
    upload_date: datetime | None = None,
) -> None:
    """Add one run to the parquet log at `path`."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}, not {status!r}")
    at = upload_date or datetime.now()
    run = spark.createDataFrame([(id, filename, at, status, rows_processed, file_size)], RUN_SCHEMA)
    run.coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def recent_runs(runs: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """The newest `n` runs; each task keeps only its own newest."""
    return runs.orderBy(F.desc("upload_date"), F.asc("id")).limit(n)
