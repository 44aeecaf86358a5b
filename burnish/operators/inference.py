"""Types for columns read as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    col,
    is_boolean_text,
    is_integer_text,
    is_number_text,
    is_unsigned_text,
    string_columns,
    to_boolean,
    to_double,
    to_long,
    to_unsigned,
)
from ..sources.csv import scan_csv
from .probe import probe


def scan_csv_typed(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """A CSV scan with each column as bigint, decimal, double, boolean or text, whichever holds all values."""
    return infer_types(scan_csv(spark, path, **options))


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest type that all their values fit.

    Whole numbers above the largest bigint are decimals of 20 digits, which hold all of 64 unsigned
    bits. Whole numbers with gaps become double and booleans with gaps stay text, as in pandas. The
    first rows rule most types out; one pass over the whole table decides on the others.
    """
    names = string_columns(df)
    tests = {}
    for n in names:
        c = col(n)
        tests |= {
            f"number {n}": is_number_text(c),
            f"integer {n}": is_integer_text(c) & c.isNotNull(),
            f"unsigned {n}": is_unsigned_text(c) & c.isNotNull(),
            f"boolean {n}": is_boolean_text(c) & c.isNotNull(),
        }
    failed = probe(df, [], tests).failed
    open_tests = {t: c for t, c in tests.items() if t not in failed}
    if not open_tests:
        return df
    refused = [F.count_if(~c).alias(f"t{i}") for i, c in enumerate(open_tests.values())]
    facts = df.agg(*refused, F.count(F.lit(1)).alias("rows")).first()
    if facts["rows"] == 0:
        return df
    holds = {t for t, bad in zip(open_tests, facts, strict=False) if bad == 0}
    typed = {}
    for n in names:
        if f"integer {n}" in holds:
            typed[n] = to_long(col(n))
        elif f"unsigned {n}" in holds:
            typed[n] = to_unsigned(col(n))
        elif f"number {n}" in holds:
            typed[n] = to_double(col(n))
        elif f"boolean {n}" in holds:
            typed[n] = to_boolean(col(n))
    return df.select(*[typed[n].alias(n) if n in typed else col(n) for n in df.columns])
