"""Cleaning a folder of files range by range, with a log of the finished ranges.

The log can be read while the job runs, and a job that was broken off goes on after the last range in it. Below the
output folder lie `plan` (what the whole table decides), `parsed` (CSV as parquet), `distinct` (the rows without copies,
if those are removed), `fills` (one row of fill values), `state` (which files belong to which range), `log` and `rows`.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col, literal_rows
from ..functions.names import distinct_names
from ..operators.cleaning import (
    TextFacts,
    convert_types,
    drop_missing,
    fill_values,
    fill_with,
    standardize_columns,
    trim_whitespace,
)
from ..operators.distinct import remove_duplicates
from ..options import RANGE_BYTES, CleanOptions
from ..sources.csv import scan_csv
from ..sources.files import exists, fingerprint
from .cleaning import decisions

_RANGE = "burnish_range"
_LOG = f"rows_processed bigint, rows_out bigint, finished_at timestamp, {_RANGE} int"


def clean_in_ranges(
    spark: SparkSession,
    source: str,
    path: str,
    options: CleanOptions | None = None,
    *,
    file_format: str = "parquet",
    bytes_per_range: int = RANGE_BYTES,
    report: Callable[[int, int, int], None] | None = None,
    **chosen,
) -> DataFrame:
    """Clean the files of the folder `source` (parquet or CSV) into the folder `path`, and return the rows.

    The rows are those of `clean`, with the same options but `scope="chunk"`. First the whole table decides on types
    and fill values, and copies are removed; each of these steps is written once. Then files of about
    `bytes_per_range` bytes at a time, at least one file, are cleaned and written as a range, and the range is logged
    (`clean_progress`). Called again with the same arguments after a failure, it goes on where it stopped: what was
    written in full is not done again, what was written in part is replaced. Other options, and files that have changed
    since, are refused. `report` is called with the number, the rows read and the rows written of each range, again if
    the range is repeated. A table without rows has no ranges or empty ones. CSV is first written as parquet.
    """
    options = CleanOptions.from_dict(chosen) if options is None else options
    if options.scope == "chunk":
        raise ValueError("ranges of files are no chunks: use clean")
    if file_format not in ("parquet", "csv"):
        raise ValueError(f"file_format must be parquet or csv, not {file_format!r}")
    asked = {"options": asdict(options), "files": fingerprint(spark, source)}
    plan = _read_plan(spark, path)
    if plan is not None and any(plan[k] != v for k, v in asked.items()):
        raise ValueError(f"{path} was begun with other options or other files")
    if file_format == "csv":
        source = _once(spark, f"{path}/parsed", lambda: scan_csv(spark, source))
    table = _renamed(spark.read.parquet(source), options)
    if plan is None:
        facts, gaps = decisions(table, options)
        plan = asked | {"facts": None if facts is None else asdict(facts), "gaps": gaps}
        text = spark.range(1).select(F.lit(json.dumps(plan)).alias("value"))
        text.coalesce(1).write.mode("overwrite").text(f"{path}/plan")
    if options.remove_duplicates:
        distinct = partial(remove_duplicates, table, strategy=options.dedup_strategy)
        source = _once(spark, f"{path}/distinct", distinct)
        table = spark.read.parquet(source)
    fills = _fills(spark, path, table, options.handle_missing, plan["gaps"] or [])

    def cleaned(rows: DataFrame) -> DataFrame:
        rows = drop_missing(rows) if options.handle_missing == "drop" else rows
        if fills is not None:
            row = fills.select(F.struct(*map(col, fills.columns))).scalar()
            rows = fill_with(rows, {n: row.getField(n) for n in fills.columns})
        rows = trim_whitespace(rows) if options.trim_whitespace else rows
        return convert_types(rows, TextFacts(**plan["facts"])) if plan["facts"] else rows

    def write(batch: DataFrame, number: int) -> None:
        read, written = Observation(), Observation()
        rows = F.count(F.lit(1)).alias("rows")
        out = cleaned(_renamed(batch, options).observe(read, rows)).observe(written, rows)
        out.write.mode("overwrite").parquet(f"{path}/rows/{_RANGE}={number}")
        counts = read.get["rows"], written.get["rows"]
        logged = [F.lit(n).cast("bigint") for n in counts] + [F.current_timestamp()]
        names = ["rows_processed", "rows_out", "finished_at"]
        record = spark.range(1).select(*[c.alias(n) for c, n in zip(logged, names, strict=True)])
        record.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{_RANGE}={number}")
        if report is not None:
            report(number, *counts)

    # Files are taken from the oldest on; none is too old for a range, however long the job has been broken off.
    stream = spark.readStream.schema(spark.read.parquet(source).schema).format("parquet")
    stream = stream.options(maxBytesPerTrigger=bytes_per_range, maxFileAge="36500d").load(source)
    writer = stream.writeStream.foreachBatch(write).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}/state").start().awaitTermination()
    schema = cleaned(table).schema
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    with_range = T.StructType([*schema, T.StructField(_RANGE, T.IntegerType())])
    return spark.read.schema(with_range).parquet(f"{path}/rows").drop(_RANGE)


def clean_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row for each finished range of `clean_in_ranges`, also while it runs: rows so far and when it was finished.

    `rows_processed` counts rows after duplicates and before incomplete ones are dropped, `rows_out` those written;
    `rows_processed_so_far` and `rows_out_so_far` add up the ranges until then.
    """
    if exists(spark, f"{path}/log"):
        log = spark.read.schema(_LOG).parquet(f"{path}/log")
    else:
        log = literal_rows(spark, _LOG, [])
    until = W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)  # one row a range
    counts = ["rows_processed", "rows_out"]
    return log.withColumnRenamed(_RANGE, "range").select(
        "range", *counts, *[F.sum(c).over(until).alias(f"{c}_so_far") for c in counts], "finished_at"
    )


def _renamed(df: DataFrame, options: CleanOptions) -> DataFrame:
    return df.toDF(*distinct_names(standardize_columns(df).columns, "_")) if options.standardize_columns else df


def _read_plan(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, f"{path}/plan/_SUCCESS"):
        return None
    return json.loads(spark.read.text(f"{path}/plan").first().value)


def _once(spark: SparkSession, path: str, rows: Callable[[], DataFrame]) -> str:
    """The folder with the rows, written unless an earlier run has finished it."""
    if not exists(spark, f"{path}/_SUCCESS"):
        rows().write.mode("overwrite").parquet(path)
    return path


def _fills(spark: SparkSession, path: str, table: DataFrame, method: str | None, gaps: list[str]) -> DataFrame | None:
    """One row with the fill value of each column that has one, or None."""
    if not gaps:
        return None
    folder = f"{path}/fills"
    if not exists(spark, f"{folder}/_SUCCESS"):
        values = fill_values(table, method, gaps)
        row = spark.range(1).select(F.lit(True).alias("__any"), *[v.alias(n) for n, v in values.items()])
        row.coalesce(1).write.mode("overwrite").parquet(folder)
    stored = spark.read.parquet(folder).drop("__any")
    return stored if stored.columns else None
