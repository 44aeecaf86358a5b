"""Rules a table must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col, percent
from .cleaning import drop_missing

# Fixed value: the pattern an e-mail address must match.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def regex_rule(df: DataFrame, column: str, pattern: str = EMAIL_PATTERN) -> DataFrame:
    """One row: how many values match the pattern, how many do not, how many are missing."""
    value = col(column)
    matches = value.rlike(pattern)
    counted = df.agg(
        F.count_if(matches).alias("valid"),
        F.count_if(~matches).alias("invalid"),
        F.count_if(value.isNull()).alias("missing"),
    )
    return counted.withColumn("valid_percentage", percent(F.col("valid"), F.col("valid") + F.col("invalid")))


def unique_rule(df: DataFrame, *columns: str) -> DataFrame:
    """Values that occur more than once, with their number; missing values do not count as equal."""
    keys = [col(c) for c in columns]
    filled = drop_missing(df, list(columns))
    return filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def expire_rows(df: DataFrame, column: str, cutoff: Column | str) -> DataFrame:
    """Rows that have not expired: those whose time is not before `cutoff`; rows without one stay."""
    return df.filter(not_expired(df, column, cutoff))


def _limit(df: DataFrame, column: str, cutoff: Column | str) -> Column:
    return F.lit(cutoff).cast(df.schema[column].dataType) if isinstance(cutoff, str) else cutoff


def expired(df: DataFrame, column: str, cutoff: Column | str) -> Column:
    return col(column) < _limit(df, column, cutoff)


def not_expired(df: DataFrame, column: str, cutoff: Column | str) -> Column:
    return col(column).isNull() | (col(column) >= _limit(df, column, cutoff))
