"""Column references and schema tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A name as Spark parses it: dots, blanks and backticks are part of it."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name."""
    return F.col(quoted(name))


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer, floating and decimal columns; booleans do not count as numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _groupable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _groupable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_groupable(f.dataType) for f in dtype)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def groupable_columns(df: DataFrame) -> list[str]:
    """Columns Spark can group by; maps and variants have no equality."""
    return [f.name for f in df.schema if _groupable(f.dataType)]


def present(field: T.StructField) -> Column:
    """The column with NaN read as missing, as `DataFrame.na` does."""
    c = col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def dtype_name(dtype: T.DataType) -> str:
    """The report's name for a declared type."""
    if isinstance(dtype, T.IntegralType):
        return "int64"
    if isinstance(dtype, T.NumericType):
        return "float64"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "object"
