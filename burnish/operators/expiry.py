"""Tables of immutable files under a list: expired rows are removed by rewriting only the files that hold some."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literal_rows
from ..sources.files import exists
from .rules import expired, not_expired

#: Files that are named at a time, in one plan.
FILES_AT_ONCE = 10_000

MANIFEST = "path string, carried boolean"


def expire_rewrite(
    spark: SparkSession, source: str, target: str, column: str, cutoff: Column | str, *, files_at_once: int = FILES_AT_ONCE
) -> None:
    """Write the rows of `source` that have not expired (as `expire_rows` says) as a new table at `target`.

    `source` is a folder of parquet files or the target of an earlier call. Files without expired rows, as the bounds in
    their footers show, are not read: the list of the new table names them where they lie. The others are read and
    their remaining rows written below `target`. The list is written last, so that a table is there as a whole or
    not at all; a call that failed is repeated from its beginning. `source` stays as it is, and must stay while `target`
    is read. The driver sees names of files. Folders partitioned by column are refused.
    """
    if exists(spark, f"{target}/manifest/_SUCCESS"):
        raise ValueError(f"there is a table at {target}")
    table = _table(spark, source)
    files = sorted(_plain(f) for f in table.inputFiles())
    if files and spark.read.parquet(files[0]).schema.names != table.schema.names:
        raise ValueError("the folder is partitioned by column")
    place = F.col("_metadata.file_path")
    # The filter reaches the footers: files and row groups without an expired row are skipped.
    touched = {_plain(r.path) for r in table.filter(expired(table, column, cutoff)).select(place.alias("path")).distinct().toLocalIterator()}
    rewritten = [f for f in files if f in touched]
    for i, part in enumerate(_parts(rewritten, files_at_once)):
        rows = spark.read.schema(table.schema).parquet(*part)
        rows.filter(not_expired(rows, column, cutoff)).write.mode("overwrite").parquet(f"{target}/rows/{i}")
    carried = [(f, True) for f in files if f not in touched]
    parts = range(-(-len(rewritten) // files_at_once))
    written = [(_plain(f), False) for i in parts for f in spark.read.parquet(f"{target}/rows/{i}").inputFiles()]
    empty = spark.createDataFrame([], table.schema)
    empty.write.mode("overwrite").parquet(f"{target}/schema")
    rows = spark.createDataFrame(carried + written, MANIFEST) if carried or written else literal_rows(spark, MANIFEST, [])
    rows.write.mode("overwrite").parquet(f"{target}/manifest")


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    """The files of a table that `expire_rewrite` has written, and which of them were carried over."""
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")


def read_kept(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a table that `expire_rewrite` has written."""
    if not exists(spark, f"{target}/manifest/_SUCCESS"):
        raise ValueError(f"no finished table at {target}")
    schema = spark.read.parquet(f"{target}/schema").schema
    files = [r.path for r in read_manifest(spark, target).toLocalIterator()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _table(spark: SparkSession, source: str) -> DataFrame:
    return read_kept(spark, source) if exists(spark, f"{source}/manifest") else spark.read.parquet(source)


def _parts(files: list[str], size: int) -> Iterator[list[str]]:
    for at in range(0, len(files), size):
        yield files[at : at + size]


def _plain(path: str) -> str:
    """The same text for both ways in which Spark names a file."""
    parts = urlsplit(path)
    return f"{parts.scheme}:{'//' + parts.netloc if parts.netloc else ''}/{unquote(parts.path).lstrip('/')}"
