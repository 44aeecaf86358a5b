"""Row order: dense row numbers, chunks and first rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col, literal_of
from ..options import CHUNK_ROWS
from .files import materialized

_POSITION = "__position"
_PARTITION = "__partition"
_WITHIN = "__within"
_FEW_ROWS = 100
#: Rows of a range that one task orders, ranges at most, and sampled keys for each.
RANGE_ROWS, MAX_RANGES, SAMPLED = 1_000_000, 16_384, 12
_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def with_row_index(
    df: DataFrame, order_by: str | None = None, *, name: str = "row_idx", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Number rows densely from 0, by `order_by` or else in scan order.

    With `order_by` the table is cut into ranges of about `range_rows` rows by a sample of its keys; the position in
    the input breaks ties, which also splits a key or a row that fills a large share of the table. The rows of each
    range are counted, from the key alone, and each range is then numbered on its own from where the one before it
    ends. The bounds are constants of the plan, so counting and numbering cut alike, and a task that is run again
    gives the same numbers; nothing is written. The input must come in the same partitions each time it is read, as
    scans do; a range that has other rows than were counted fails the query.

    Without `order_by` the partitions are the ranges. The placed rows are written to the shared folder first, as
    any input may be numbered so. If `order_by` is the `position` of a CSV scan, nothing is moved or written: the
    rows of each block of a file are counted, and numbered in place.
    """
    if order_by is not None and _is_position(df.schema[order_by].dataType):
        return _numbered_by_block(df, order_by, name)
    if order_by is not None:
        return _numbered_by_range(df, order_by, name, range_rows)
    position = F.monotonically_increasing_id()
    placed = materialized(df.withColumn(_POSITION, position))
    placed = placed.withColumn(_PARTITION, F.shiftright(_POSITION, _PARTITION_BITS))

    # One row per partition: bounded by the number of tasks, small enough for one window and a
    # broadcast at any table size.
    before = W.orderBy(_PARTITION).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy(_PARTITION)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(_PARTITION, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    )
    within = F.col(_POSITION).bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    numbered = placed.join(F.broadcast(starts), _PARTITION).withColumn(name, F.col("__start") + within)
    return numbered.drop(_POSITION, _PARTITION, "__start")


def _numbered_by_range(df: DataFrame, order_by: str, name: str, range_rows: int) -> DataFrame:
    kind = df.schema[order_by].dataType
    placed = df.withColumn(_POSITION, F.monotonically_increasing_id())
    here = F.struct(col(order_by).alias("key"), F.col(_POSITION).alias("at"))
    total = df.count()
    ranges = min(MAX_RANGES, -(-total // range_rows))
    bounds = []
    if ranges > 1:
        # Some sampled keys for each range; every few of them is a bound.
        sample = placed.select(here.alias("here")).sample(min(1.0, SAMPLED * ranges / total), seed=5)
        sampled = [r["here"] for r in sample.orderBy("here").collect()]
        bounds = [sampled[i * len(sampled) // ranges] for i in range(1, ranges)] if sampled else []
    placed = placed.withColumn(_PARTITION, _range_of(here, bounds, kind))
    counts = {r[_PARTITION]: r["count"] for r in placed.groupBy(_PARTITION).count().collect()}
    sizes = [counts.get(i, 0) for i in range(len(bounds) + 1)]
    starts = list(accumulate([0, *sizes[:-1]]))
    within = F.row_number().over(W.partitionBy(_PARTITION).orderBy(col(order_by), _POSITION))
    size, start = (F.get(F.lit(x), F.col(_PARTITION)) for x in (sizes, starts))
    message = F.lit("rows came in other partitions than they were counted in")
    number = F.when(F.col(_WITHIN) <= size, start.cast("bigint") + F.col(_WITHIN) - 1).otherwise(F.raise_error(message).cast("bigint"))
    return placed.withColumn(_WITHIN, within).withColumn(name, number).drop(_POSITION, _PARTITION, _WITHIN)


def _range_of(here: Column, bounds: list, kind: T.DataType) -> Column:
    """How many of the sorted bounds are not above the key and position: a binary search in constants."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*[F.struct(literal_of(b["key"], kind).alias("key"), F.lit(b["at"]).cast("bigint").alias("at")) for b in bounds])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= here, at + step).otherwise(at)
    )


def _is_position(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and dtype.names == ["file", "block", "row"]


def _numbered_by_block(df: DataFrame, position: str, name: str) -> DataFrame:
    at = col(position)
    block = [at["file"].alias("__file"), at["block"].alias("__block")]
    counts = df.groupBy(*block).agg(F.count(F.lit(1)).alias("__rows"), F.min(at["row"]).alias("__first"))
    # One row for each block of a file.
    before = W.orderBy("__file", "__block").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")
    starts = counts.select("__file", "__block", start.alias("__start"))
    placed = df.select("*", *block).join(starts, ["__file", "__block"])
    return placed.withColumn(name, F.col("__start") + at["row"]).drop("__file", "__block", "__start")


def with_chunk(
    df: DataFrame, row_idx: str = "row_idx", *, chunk_rows: int = CHUNK_ROWS, name: str = "chunk_id"
) -> DataFrame:
    """The chunk each row falls into: row number over chunk size, rounded down."""
    return df.withColumn(name, F.floor(col(row_idx) / chunk_rows))


def first_n(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """The first `n` rows by `order_by`, a key without repeats; rows without a key come last.

    A bound on the key filters the scan first, so parquet skips the row groups behind it and the
    other columns are read for the first rows only. For a few rows the bound is the n-th smallest
    key. Sorting out n keys per task would be too much for one task if n is large; then a sample of
    the keys gives a bound, and a count proves that enough rows lie below it.
    """
    if n < 1:
        return df.limit(0)
    key: Column = col(order_by)
    by = key.asc_nulls_last()
    keys = df.filter(key.isNotNull()).select(key.alias("k"))
    if n <= _FEW_ROWS:
        found = keys.orderBy("k").limit(n).agg(F.struct(F.max("k").alias("k"), F.count("k").alias("n"))).first()[0]
        if found["n"] == n:
            df = df.filter(key <= literal_of(found["k"], df.schema[order_by].dataType))
        return df.orderBy(by).limit(n)
    # About 20 of the n wanted keys are sampled, so the 60th sampled key lies well behind them.
    sampled = keys.sample(20 / n, seed=7).orderBy("k").limit(60)
    bound = sampled.agg(F.max("k").alias("k"), F.count("k").alias("n")).first()
    if bound["n"] == 60:
        last = literal_of(bound["k"], df.schema[order_by].dataType)
        if keys.filter(F.col("k") <= last).count() >= n:
            df = df.filter(key <= last)
    return df.orderBy(by).limit(n)
