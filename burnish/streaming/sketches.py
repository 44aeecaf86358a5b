"""Sketches of files, kept: a folder that grows is profiled without reading its older files again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import groupable_columns, is_missing, literal_rows, numeric_columns, present
from ..sources.files import exists

#: Sizes of the sketches: 2^12 registers a column for distinct values, 400 values a level for quantiles, 2^12 hashes of rows.
DISTINCT_LG, QUANTILE_K, ROWS_LG = 12, 400, 12

_BATCH = "batch_id"
_SCHEMA = (
    "file string, ordinal int, column string, rows bigint, filled bigint, distinct_values binary, quantiles binary, "
    "mean double, m2 double, min double, max double, distinct_rows binary"
)


def distinct_error(lg: int = DISTINCT_LG) -> float:
    """Relative standard error of distinct counts of columns."""
    return 1.04 / 2 ** (lg / 2)


def rank_error(k: int = QUANTILE_K) -> float:
    """The share of the rows by which a median's rank is off, in 99 of 100 cases."""
    return 2.296 / k**0.9723


def rows_error(lg: int = ROWS_LG) -> float:
    """Relative standard error of the distinct rows."""
    return 1 / (2**lg - 1) ** 0.5


def sketch_files(spark: SparkSession, source: str, store: str, *, schema: T.StructType | str | None = None) -> None:
    """Sketch the parquet files of the folder `source` that are new since the last call, into the folder `store`.

    A file gets a row for each column, with counts, moments and sketches of fixed size, and one for its rows as a whole.
    Which files are done is kept in `store`, and a call that failed half-way is repeated for the files it was at.
    Files are expected to be added only: one that is replaced or taken away stays counted as it was. All have the
    columns of `schema`, or else those found now. A file without rows has none here. Maps have no distinct values; a table with maps has no sketch of rows.
    """
    table = spark.readStream.schema(schema or spark.read.parquet(source).schema).format("parquet")
    files = table.option("maxFileAge", "36500d").load(source)
    names = files.columns
    fields = {f.name: f for f in files.schema}

    def write(batch: DataFrame, number: int) -> None:
        facts = [_facts(i, fields[n], n in numeric_columns(files), n in groupable_columns(files)) for i, n in enumerate(names)]
        whole = len(groupable_columns(files)) == len(names)
        facts.append(_row_facts([fields[n] for n in names]) if whole else _row_facts(None))
        named = [f.alias(f"f{i}") for i, f in enumerate(facts)]
        wide = batch.groupBy(F.col("__file").alias("file")).agg(*named)
        long = wide.select("file", F.inline(F.array(*[F.col(f"f{i}") for i in range(len(facts))])))
        long.write.mode("overwrite").parquet(f"{store}/sketches/{_BATCH}={number}")

    placed = files.select("*", F.col("_metadata.file_path").alias("__file"))
    writer = placed.writeStream.foreachBatch(write).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{store}/state").start().awaitTermination()


_FACTS = dict(field.split(" ") for field in _SCHEMA.split(", ") if not field.startswith("file "))


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FACTS.items()])


def _hashed(field: T.StructField) -> Column:
    """A hash of the value, equal for both zeros, and null where it is missing."""
    c = present(field)
    c = c + F.lit(0.0).cast(field.dataType) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else c
    return F.when(c.isNotNull(), F.xxhash64(c))


def _facts(ordinal: int, field: T.StructField, numeric: bool, groupable: bool) -> Column:
    found = {
        "ordinal": F.lit(ordinal),
        "column": F.lit(field.name),
        "rows": F.count(F.lit(1)),
        "filled": F.count_if(~is_missing(field)),
    }
    if groupable:
        found["distinct_values"] = F.hll_sketch_agg(_hashed(field), DISTINCT_LG)
    if numeric:
        v = present(field).cast("double")
        found |= {"quantiles": F.kll_sketch_agg_double(v, QUANTILE_K), "mean": F.avg(v), "m2": F.var_pop(v) * F.count(v),
                  "min": F.min(v), "max": F.max(v)}
    return _struct(found)


def _row_facts(fields: list[T.StructField] | None) -> Column:
    found = {"ordinal": F.lit(-1), "rows": F.count(F.lit(1))}
    if fields is not None:
        # A hash skips nulls, so their places are hashed as well.
        gaps = F.concat_ws("", *[F.when(present(f).isNull(), "1").otherwise("0") for f in fields])
        found["distinct_rows"] = F.theta_sketch_agg(F.xxhash64(gaps, *[_hashed(f) for f in fields]), ROWS_LG)
    return _struct(found)


def read_sketches(spark: SparkSession, store: str) -> DataFrame:
    """The stored rows: a row for each file and column, and one with the ordinal -1 for each file."""
    if not exists(spark, f"{store}/sketches"):
        return literal_rows(spark, _SCHEMA, [])
    return spark.read.schema(f"{_SCHEMA}, {_BATCH} int").parquet(f"{store}/sketches").drop(_BATCH)


def sketched_profile(spark: SparkSession, store: str) -> DataFrame:
    """One row per column of all files sketched so far: counts, mean, deviation, bounds; distinct values and median about.

    Counts and bounds are exact. Deviations of files are put together around the common mean, so that none cancels out.
    Distinct values have a relative standard error of `distinct_error()`; the rank of the median is off by at most
    `rank_error()` of the rows in 99 of 100 cases. Only stored sketches are read, and merged within each task first.
    """
    files = read_sketches(spark, store).filter("ordinal >= 0")
    n = F.sum("filled")
    totals = files.groupBy("ordinal", "column").agg(
        F.sum("rows").alias("rows"),
        n.alias("filled"),
        F.when(F.count("distinct_values") > 0, F.hll_union_agg("distinct_values", F.lit(True))).alias("distinct_values"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        (F.sum(F.col("mean") * F.col("filled")) / F.nullif(n, F.lit(0))).alias("mean"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    # One row for each column of the table.
    centres = F.broadcast(totals.select("ordinal", F.col("mean").alias("centre")))
    apart = F.col("mean") - F.col("centre")
    spread = files.join(centres, "ordinal").groupBy("ordinal").agg(F.sum(F.col("m2") + F.col("filled") * apart * apart).alias("m2"))
    numeric = F.col("mean").isNotNull()
    return totals.join(F.broadcast(spread), "ordinal", "left").select(
        "ordinal", "column", "rows",
        (F.col("rows") - F.col("filled")).alias("missing_count"),
        F.hll_sketch_estimate("distinct_values").alias("unique_values"),
        "mean",
        F.when(numeric, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("median"),
        F.when(F.col("filled") > 1, F.sqrt(F.col("m2") / (F.col("filled") - 1))).alias("std"),
        "min", "max",
    )


def sketched_duplicates(spark: SparkSession, store: str) -> DataFrame:
    """One row: the rows of all files sketched so far, and about how many of them are copies.

    The distinct rows have a relative standard error of `rows_error()`; up to 2^12 of them are counted exactly. Null for
    a table with maps.
    """
    files = read_sketches(spark, store).filter("ordinal = -1")
    rows = F.coalesce(F.sum("rows"), F.lit(0))
    merged = files.agg(
        rows.alias("rows"),
        F.count_if(F.col("distinct_rows").isNull()).alias("lacking"),
        F.theta_union_agg("distinct_rows", ROWS_LG).alias("sketch"),
    )
    distinct = F.least("rows", F.theta_sketch_estimate("sketch"))
    return merged.select("rows", F.when(F.col("lacking") == 0, F.col("rows") - distinct).alias("duplicate_rows"))


