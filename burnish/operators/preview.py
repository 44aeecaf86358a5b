"""First rows, and rows as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import present
from ..options import PREVIEW_ROWS
from ..sources.order import first_n


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: str | None = None) -> DataFrame:
    """The first rows to show, by `order_by` or as the scan meets them.

    Read the file with `bad_lines="skip"` to leave out broken ones.
    """
    return df.limit(n) if order_by is None else first_n(df, n, order_by)


def _json_value(field: T.StructField) -> Column:
    native = (T.NumericType, T.BooleanType, T.ArrayType, T.StringType)
    value = present(field)
    return value if isinstance(field.dataType, native) else value.cast("string")


def to_json_records(df: DataFrame) -> DataFrame:
    """Each row as a JSON object: numbers, booleans and arrays as such, the rest as text, nulls kept."""
    record = F.struct(*[_json_value(f).alias(f.name) for f in df.schema])
    return df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))
