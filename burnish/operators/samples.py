"""Sample values per column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import col, column_values, literal_rows, name_at, present
from ..options import SAMPLE_VALUES
from ..sources.order import first_n

PREFIX_ROWS = 100


def sample_values(
    df: DataFrame,
    order_by: str,
    *,
    n: int = SAMPLE_VALUES,
    empty: Sequence[str] = (),
    prefix_rows: int = PREFIX_ROWS,
) -> DataFrame:
    """(column, sample_values): the first `n` non-missing values of each column by `order_by`, as text.

    Nearly always the first rows hold them, and those are cheap to read. Columns with too few values
    there are looked for in one scan of the whole table, all of them together; each task passes on
    `n` values of a column. `empty` names columns known to have no value at all.
    """
    fields = {f.name: f for f in df.schema}
    names = [c for c in df.columns if c not in empty]
    texts = df.select(
        col(order_by).alias("__row"),
        *[present(fields[c]).cast("string").alias(f"v{i}") for i, c in enumerate(names)],
    )
    prefix = first_n(texts, prefix_rows, "__row")
    found = prefix.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in texts.columns[1:]]).first()
    behind = [c for c in texts.columns[1:] if found[c] < n and found["rows"] >= prefix_rows]

    def long(source: DataFrame, columns: list[str]) -> DataFrame:
        cells = column_values(source, columns, keep=["__row"])
        return cells.select("__row", name_at([names[int(c[1:])] for c in columns]).alias("column"), "value")

    parts = [long(prefix, [c for c in texts.columns[1:] if c not in behind])] if len(behind) < len(names) else []
    if behind:
        parts.append(long(texts.select("__row", *behind), behind))
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.col("__row").asc_nulls_last()))
    kept = reduce(DataFrame.unionByName, parts).withColumn("__rank", rank).filter(F.col("__rank") <= n)
    collected = kept.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("__rank", "value"))).getField("value").alias("sample_values")
    )
    labels = literal_rows(df.sparkSession, "column string", [(c,) for c in df.columns])
    none = F.array().cast("array<string>")
    # One row per column of the table.
    return labels.join(F.broadcast(collected), "column", "left").select(
        "column", F.coalesce("sample_values", none).alias("sample_values")
    )
