"""Counts over the whole table: rows, cells, missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_missing, percent
from ..options import LARGE_TABLE_ROWS


def _missing_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(is_missing(field)) for field in df.schema]


def table_counts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, missing cells, their share, and whether the table is large."""
    width = len(df.columns)
    missing = [m.alias(f"missing{i}") for i, m in enumerate(_missing_counts(df))]
    counted = df.agg(F.count(F.lit(1)).alias("total_rows"), *missing)
    # An array keeps the expression flat; a sum of a thousand terms would be a thousand levels deep.
    each = F.array(*[F.col(f"missing{i}") for i in range(width)]).cast("array<bigint>")
    total = F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a + b)
    counted = counted.select("total_rows", total.alias("missing_cells"))
    cells = F.col("total_rows") * width
    return counted.select(
        "total_rows",
        F.lit(width).cast("bigint").alias("total_columns"),
        cells.alias("total_cells"),
        "missing_cells",
        percent(F.col("missing_cells"), cells).alias("missing_percentage"),
        (F.col("total_rows") > LARGE_TABLE_ROWS).alias("is_large_file"),
    )


def one_row_per_column(wide: DataFrame, facts: dict[str, dict[str, str]]) -> DataFrame:
    """Turn a one-row aggregate into one row per column.

    `facts` maps a column name to {output field: field of `wide`}.
    """
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("column"),
            *[F.col(source).alias(field) for field, source in fields.items()],
        )
        for i, (name, fields) in enumerate(facts.items())
    ]
    return wide.select(F.inline(F.array(*rows)))


def column_missing(df: DataFrame) -> DataFrame:
    """Missing count and share per column: one pass, one aggregate row, then one row per column."""
    aggregates = [F.count(F.lit(1)).alias("total_rows")]
    facts = {}
    for i, (name, missing) in enumerate(zip(df.columns, _missing_counts(df), strict=True)):
        aggregates.append(missing.alias(f"missing{i}"))
        facts[name] = {"missing_count": f"missing{i}", "total_rows": "total_rows"}
    return one_row_per_column(df.agg(*aggregates), facts).select(
        "ordinal",
        "column",
        "missing_count",
        percent(F.col("missing_count"), F.col("total_rows")).alias("missing_percentage"),
    )
