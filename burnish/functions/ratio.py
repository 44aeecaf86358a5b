"""Percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """`part` of `whole` in percent with two decimals; 0 when there is no whole."""
    share = F.round(part.cast("double") * 10000.0 / F.nullif(whole.cast("double"), F.lit(0.0))) / 100
    return F.coalesce(share, F.lit(0.0))
