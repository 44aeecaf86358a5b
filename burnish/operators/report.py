"""Small tables a dashboard draws, derived from the profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import short_name

SHOWN_COLUMNS = 10  # fixed value: how many columns a chart shows
PARTIAL_BELOW = 10  # fixed value: percent missing from which a column counts as missing


def dtype_distribution(columns: DataFrame) -> DataFrame:
    """Columns per type."""
    return columns.groupBy("dtype").agg(F.count(F.lit(1)).alias("columns"))


def completeness_split(table: DataFrame) -> DataFrame:
    """Two rows: complete and missing cells."""
    parts = F.array(
        F.struct(F.lit("Complete").alias("name"), (F.col("total_cells") - F.col("missing_cells")).alias("value")),
        F.struct(F.lit("Missing").alias("name"), F.col("missing_cells").alias("value")),
    )
    return table.select(F.inline(parts))


def missing_by_column(columns: DataFrame, *, n: int = SHOWN_COLUMNS, order: str = "column") -> DataFrame:
    """The first `n` columns with gaps, in table order, or with `order="missing"` the emptiest ones."""
    shown = columns.filter(F.col("missing_percentage") > 0)
    sorting = [F.desc("missing_percentage"), F.asc("ordinal")] if order == "missing" else [F.asc("ordinal")]
    return shown.orderBy(*sorting).limit(n).select(
        short_name(F.col("column")).alias("name"),
        F.col("missing_percentage").alias("missing"),
        (100 - F.col("missing_percentage")).alias("complete"),
    )


def missing_heat_bucket(columns: DataFrame, *, n: int = SHOWN_COLUMNS) -> DataFrame:
    """Complete, partial or missing for each of the first `n` columns."""
    share = F.col("missing_percentage")
    bucket = F.when(share == 0, "complete").when(share < PARTIAL_BELOW, "partial").otherwise("missing")
    return columns.orderBy("ordinal").limit(n).select("column", bucket.alias("status"), share.alias("percentage"))
