"""What counts as a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col, present

# The texts that pandas' CSV reader takes for a missing value.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def as_missing(c: Column) -> Column:
    """Null where a text is one of the missing-value tokens; case and blanks matter."""
    return F.when(~c.isin(*NA_TOKENS), c)


def normalize_na(df: DataFrame) -> DataFrame:
    """Turn the missing-value tokens of every string column into nulls."""
    return df.select(
        *[
            as_missing(col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name)
            for f in df.schema
        ]
    )


def is_missing(field: T.StructField) -> Column:
    return present(field).isNull()
