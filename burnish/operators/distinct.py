"""Distinct values, histograms and duplicate rows.

Every count here groups on the value itself, so a value or row that fills a third of the table is
folded into one partial row per task before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col, column_values, groupable_columns, literal_rows, name_at, present
from ..options import (
    CHUNK_ROWS,
    DISTINCT_CAP,
    DISTINCT_CHUNKS,
    DISTINCT_PER_CHUNK,
    ONE_TASK_ROWS,
    SAMPLE_ROWS,
)
from ..sources.order import first_n, with_chunk
from .probe import probe

_SAMPLE_ROWS = 100_000


def _widened(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.IntegralType):
        return T.LongType()
    if isinstance(dtype, T.FloatType):
        return T.DoubleType()
    return dtype


def value_counts(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[int]]:
    """(position, v0, v1, …, occurrences) for all columns in one scan, and which of v0, v1, … each column uses.

    Columns that can share one value column without losing their order or equality do; a row fills
    one of them. Missing values are left out.
    """
    fields = {f.name: f for f in df.schema}
    wide = [_widened(fields[n].dataType) for n in columns]
    types = list(dict.fromkeys(wide))
    cells: list[Column] = [F.lit(len(columns))]
    for i, n in enumerate(columns):
        value = present(fields[n]).cast(wide[i])
        cells += [F.lit(i), *[value if t == wide[i] else F.lit(None).cast(t) for t in types]]
    names = [f"v{k}" for k in range(len(types))]
    filled = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in names])
    long = df.select(F.stack(*cells).alias("position", *names)).filter(filled)
    counted = long.groupBy("position", *names).agg(F.count(F.lit(1)).alias("occurrences"))
    return counted, [types.index(t) for t in wide]


def distinct_counts(df: DataFrame, columns: list[str] | None = None, *, exact: bool = True) -> DataFrame:
    """Distinct non-missing values per column.

    Exact counts need a shuffle of the distinct values; `exact=False` uses a fixed-size sketch.
    """
    names = groupable_columns(df) if columns is None else columns
    if not names:
        return literal_rows(df.sparkSession, "column string, unique_values bigint", [])
    if not exact:
        fields = {f.name: f for f in df.schema}
        wide = df.agg(*[F.approx_count_distinct(present(fields[n])).alias(f"u{i}") for i, n in enumerate(names)])
        rows = [F.struct(F.lit(n).alias("column"), F.col(f"u{i}").alias("unique_values")) for i, n in enumerate(names)]
        return wide.select(F.inline(F.array(*rows)))
    counted, _ = value_counts(df, names)
    found = counted.groupBy("position").agg(F.count(F.lit(1)).alias("unique_values"))
    # A column with nothing but missing values has no group, yet belongs in the answer.
    zero = literal_rows(df.sparkSession, "column string, unique_values bigint", [(n, 0) for n in names])
    every = found.select(name_at(names).alias("column"), "unique_values").unionByName(zero)
    return every.groupBy("column").agg(F.sum("unique_values").alias("unique_values"))


def plentiful(df: DataFrame, columns: list[str], rows: int, *, cap: int = DISTINCT_CAP) -> list[str]:
    """The columns that a sample of a table of `rows` rows proves to have `cap` distinct values.

    Two different hashes come from two different values, so a count of hashes never exceeds the count
    of values. Only the hashes of sampled rows are shuffled.
    """
    if not columns or rows < cap:
        return []
    fields = {f.name: f for f in df.schema}
    sample = df.select(*[col(n) for n in columns]).sample(min(1.0, _SAMPLE_ROWS / rows), seed=11)
    values = [present(fields[n]) for n in columns]
    hashes = sample.select(*[F.when(v.isNotNull(), F.xxhash64(v)).alias(f"h{i}") for i, v in enumerate(values)])
    seen = column_values(hashes, hashes.columns).distinct().groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    return [columns[r["position"]] for r in seen.filter(F.col("n") >= cap).collect()]


def distinct_labels(df: DataFrame, columns: list[str] | None = None, *, cap: int = DISTINCT_CAP) -> DataFrame:
    """Distinct values per column as text: the exact number below `cap`, else `<cap>+`.

    The first rows show for most key columns that they reach the cap, and a sample of all rows for
    those that hide it, as a sorted column does. Only the rest is counted exactly, so the values of a
    key column are not shuffled.
    """
    names = groupable_columns(df) if columns is None else columns
    if not names:
        return literal_rows(df.sparkSession, "column string, unique_values string", [])
    many = probe(df, names).many(cap)
    if unsure := [n for n in names if n not in many]:
        many += plentiful(df, unsure, df.count(), cap=cap)
    return label_distinct(df, names, many, cap=cap)


def label_distinct(df: DataFrame, names: list[str], many: list[str], *, cap: int = DISTINCT_CAP) -> DataFrame:
    """Labels for `names`, of which `many` are known to reach the cap."""
    plus = F.lit(f"{cap}+")
    few = distinct_counts(df, [n for n in names if n not in many])
    label = F.when(F.col("unique_values") < cap, F.col("unique_values").cast("string")).otherwise(plus)
    labelled = few.select("column", label.alias("unique_values"))
    if many:
        known = literal_rows(df.sparkSession, "column string", [(n,) for n in many])
        labelled = labelled.unionByName(known.select("column", plus.alias("unique_values")))
    return labelled


def bounded_distinct(
    df: DataFrame,
    order_by: str,
    *,
    chunk_rows: int = CHUNK_ROWS,
    chunks: int = DISTINCT_CHUNKS,
    per_chunk: int = DISTINCT_PER_CHUNK,
) -> DataFrame:
    """Distinct values among the first `per_chunk` distinct ones of each of the first `chunks` chunks.

    `order_by` is the dense row number; its filter reaches the scan, so a bounded number of rows is read.
    """
    names = [n for n in groupable_columns(df) if n != order_by]
    head = with_chunk(df.filter(col(order_by) < chunks * chunk_rows), order_by, chunk_rows=chunk_rows, name="__chunk")
    fields = {f.name: f for f in df.schema}
    texts = head.select(
        "__chunk", col(order_by).alias("__row"), *[present(fields[n]).cast("string").alias(n) for n in names]
    )
    long = column_values(texts, names, keep=["__chunk", "__row"])
    first_seen = long.groupBy("position", "__chunk", "value").agg(F.min("__row").alias("__row"))
    rank = F.row_number().over(W.partitionBy("position", "__chunk").orderBy("__row"))
    kept = first_seen.withColumn("__rank", rank).filter(F.col("__rank") <= per_chunk)
    distinct = kept.select(name_at(names).alias("column"), "value").distinct()
    counted = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"))
    zero = literal_rows(df.sparkSession, "column string, unique_values bigint", [(n, 0) for n in names])
    return counted.unionByName(zero).groupBy("column").agg(F.sum("unique_values").alias("unique_values"))


def _surplus_rows(df: DataFrame) -> DataFrame:
    """(rows, distinct rows); nulls equal nulls."""
    copies = df.groupBy(*[col(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")
    )


def duplicate_rows(df: DataFrame, *, strategy: str = "rows", max_lookup: int = ONE_TASK_ROWS) -> DataFrame:
    """One row: how many rows repeat an earlier one. `strategy` is that of `remove_duplicates`."""
    if split := _split(df, df.columns, strategy, max_lookup):
        df = split[1]
    return _surplus_rows(df).select((F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def duplicate_estimate(df: DataFrame, order_by: str, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Repeats among the first `sample_rows` rows, scaled to the table and rounded down.

    `order_by` places the rows and is not compared.
    """
    sample = first_n(df, sample_rows, order_by).drop(order_by)
    total = df.agg(F.count(F.lit(1))).scalar()
    share = (F.col("rows") - F.col("distinct_rows")) * total / F.greatest(F.col("rows"), F.lit(1))
    return _surplus_rows(sample).select(F.floor(share).cast("bigint").alias("duplicate_rows"))


def _row_hash(names: list[str]) -> Column:
    """A 64-bit hash of the row. `xxhash64` skips nulls, so their places are hashed as well."""
    nulls = F.concat(*[F.when(col(n).isNull(), "1").otherwise("0") for n in names])
    return F.xxhash64(nulls, *[col(n) for n in names])


def _split(df: DataFrame, names: list[str], strategy: str, max_lookup: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows whose hash over `names` is their own, and the others; None for whole-row comparison."""
    if strategy == "rows":
        return None
    if strategy != "hash":
        raise ValueError(f"strategy must be 'rows' or 'hash', not {strategy!r}")
    hashed = df.withColumn("__hash", _row_hash(names))
    repeated = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__hash")
    if repeated.count() > max_lookup:
        return None
    lookup = F.broadcast(repeated)
    alone = hashed.join(lookup, "__hash", "left_anti").drop("__hash")
    return alone, hashed.join(lookup, "__hash", "left_semi").drop("__hash")


def remove_duplicates(
    df: DataFrame, *, strategy: str = "rows", order_by: str | None = None, max_lookup: int = ONE_TASK_ROWS
) -> DataFrame:
    """Keep one of each group of equal rows; nulls equal nulls.

    `order_by` names a column that is not compared; the first row by it stays. Without it equal rows
    are the same and any may stay.

    `rows` shuffles the rows once, folding the copies within each task first. `hash` is for wide
    rows with few copies: it shuffles an 8-byte hash per row, lets every row whose hash is its own
    pass where it is, and compares only the rest in full. That needs the repeated hashes on every
    executor, so they are counted first; more than `max_lookup` of them fall back to `rows`.
    """
    names = [n for n in df.columns if n != order_by]

    def first(rows: DataFrame) -> DataFrame:
        if order_by is None:
            return rows.dropDuplicates()
        kept = rows.groupBy(*[col(n) for n in names]).agg(F.min(col(order_by)).alias(order_by))
        return kept.select(*[col(n) for n in df.columns])

    if split := _split(df, names, strategy, max_lookup):
        alone, suspects = split
        return alone.unionByName(first(suspects))
    return first(df)
