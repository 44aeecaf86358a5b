"""Numbers written as text.

Spark's own string-to-double cast is both wider (`12d`, `NaN`) and, in ANSI mode, fatal on bad
input; so a pattern decides what is a number and `try_cast` does the rest.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number grammar of pandas' to_numeric, and the whole numbers it holds.
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*\z"
NUMBER_PATTERN = (
    r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
    r"|^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?\z"
)
LEAST_WHOLE, LARGEST_WHOLE = Decimal(-(2**63)), Decimal(2**64 - 1)
BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")


def is_number_text(c: Column) -> Column:
    """True for a text that reads as a number; an empty text reads as missing, so it passes.

    Numbers too large for a double, and whole numbers of more than 64 bits, do not count: they stay
    text rather than lose digits.
    """
    short = (F.length(c) <= 18) & ~c.contains("e") & ~c.contains("E")
    whole = c.try_cast("decimal(38,0)").between(LEAST_WHOLE, LARGEST_WHOLE)
    in_range = (
        F.when(short, True)
        .when(c.rlike(INTEGER_PATTERN), F.coalesce(whole, F.lit(False)))
        .otherwise(F.abs(to_double(c)) < float("inf"))
    )
    return (c == "") | (c.rlike(NUMBER_PATTERN) & in_range)


def is_integer_text(c: Column) -> Column:
    """True for a whole number that fits 64 bits; an empty text passes."""
    fits = F.when(F.length(c) <= 18, True).otherwise(to_long(c).isNotNull())
    return (c == "") | (c.rlike(INTEGER_PATTERN) & fits)


def is_unsigned_text(c: Column) -> Column:
    """True for a whole number from 0 to 2^64 - 1; an empty text passes."""
    value = c.try_cast("decimal(38,0)")
    return (c == "") | (c.rlike(INTEGER_PATTERN) & F.coalesce(value.between(0, LARGEST_WHOLE), F.lit(False)))


def is_boolean_text(c: Column) -> Column:
    return c.isin(*BOOLEAN_TEXTS)


def to_long(c: Column) -> Column:
    return c.try_cast("bigint")


def to_unsigned(c: Column) -> Column:
    """Exact up to 2^64 - 1, as pandas' unsigned integers are."""
    return c.try_cast("decimal(20,0)")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_boolean(c: Column) -> Column:
    return F.lower(c) == "true"
