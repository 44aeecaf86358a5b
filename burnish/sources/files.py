"""Files: parquet scans, admission by name and size, sizes, the shared working folder."""

from __future__ import annotations

import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..options import MAX_FILE_BYTES, ONE_TASK_ROWS

BYTES_PER_MB = 1024 * 1024


def scan_parquet(spark: SparkSession, directory: str, name: str, *, row_index: str | None = None) -> DataFrame:
    """A parquet table; `row_index` names a column to add with its row numbers.

    Rows are numbered densely from 0, by file name and by place in the file. Parquet knows the place,
    so only the rows per file are counted, from the footers; no row is moved, sorted or written.
    """
    path = f"{directory}/{name}.parquet"
    df = spark.read.parquet(path)
    if row_index is None:
        return df
    file, place = "__file", "__place"
    sizes = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias(file)).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy(file).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(file, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    # One row per file; a broadcast only for as many files as every executor can hold.
    if sizes.count() <= ONE_TASK_ROWS // 10:
        starts = F.broadcast(starts)
    placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    numbered = placed.join(starts, file).withColumn(row_index, F.col("__start") + F.col(place))
    return numbered.drop(file, place, "__start")


def _listing(spark: SparkSession, path: str) -> DataFrame:
    # Without the `content` column the source only lists the files and opens none.
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def fingerprint(spark: SparkSession, path: str) -> list[int]:
    """Number, bytes and a checksum of names, lengths and times of the files below `path`: it changes if they do."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    checksum = F.sum(F.xxhash64("path", "length", "modificationTime").bitwiseAND(0xFFFFFFFF))
    row = reader.agg(F.count(F.lit(1)), F.sum("length"), checksum).first()
    return [int(x or 0) for x in row]


def admit_files(
    spark: SparkSession, path: str, *, extension: str = "csv", max_bytes: int | None = MAX_FILE_BYTES
) -> DataFrame:
    """Files below `path` with the extension, in any case, and at most `max_bytes` long (None: any length)."""
    files = _listing(spark, path)
    wanted: Column = F.lower(F.element_at(F.split("path", r"\."), -1)) == extension.lower()
    if max_bytes is not None:
        wanted = wanted & (F.col("length") <= max_bytes)
    return files.filter(wanted)


def size_mb(spark: SparkSession, path: str) -> DataFrame:
    """One row with the size of all files below `path` in MiB, two decimals."""
    total = F.coalesce(F.sum("length"), F.lit(0))
    return _listing(spark, path).agg(F.round(total / BYTES_PER_MB, 2).alias("size_mb"))


def working_dir(spark: SparkSession) -> str:
    """The folder every executor shares: `spark.checkpoint.dir`, or the context's checkpoint folder.

    A cluster must name one. Only a local session that names none, as a test may, gets a temporary one;
    the session's own settings stay as they are.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"{application}-")


def materialized(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once as parquet to the shared folder and read back from there.

    Unlike a checkpoint, the table can be read by column. `clear_materialized` deletes it.
    """
    path = f"{working_dir(df.sparkSession)}/burnish-{uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def clear_materialized(spark: SparkSession) -> None:
    """Delete the tables that operators have written to the shared folder; results that still read them end."""
    while _WRITTEN:
        target = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
