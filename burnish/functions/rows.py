"""Rows built from constants, and columns turned into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        # `$` could start a variable that Spark would replace inside the text.
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"
    return f"'{value}'"


def literal_rows(spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """A DataFrame of constants, such as one row per column of a table, built without a Python scan."""
    fields = [part.rsplit(" ", 1) for part in schema.split(", ")]
    typed = ", ".join(f"CAST(c{i} AS {t}) AS `{n}`" for i, (n, t) in enumerate(fields))
    columns = ", ".join(f"c{i}" for i in range(len(fields)))
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows or [[None] * len(fields)])
    found = spark.sql(f"SELECT {typed} FROM VALUES {values} AS v({columns})")
    return found if rows else found.limit(0)


def literal_of(value: object, dtype: T.DataType) -> Column:
    """A constant of the given type for a value read from a row, a struct included."""
    constant = F.struct(*map(F.lit, value)) if isinstance(value, Row) else F.lit(value)
    return constant.cast(dtype)


def column_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(position, value) for every filled cell of columns of one type, next to the columns to `keep`.

    A column is named by its position: a number makes a smaller and faster grouping key than a name.
    """
    cells: list[Column] = [F.lit(len(columns))]
    for i, n in enumerate(columns):
        cells += [F.lit(i), col(n)]
    long = df.select(*[col(k) for k in keep], F.stack(*cells).alias("position", "value"))
    return long.filter("value IS NOT NULL")


def name_at(columns: Sequence[str], position: str = "position") -> Column:
    """The column name for a position given by `column_values`."""
    return F.element_at(F.array(*[F.lit(n) for n in columns]), F.col(position) + 1)


def row_digest(df: DataFrame) -> Column:
    """40 bytes of a row that has no map: the SHA-256 of its values written as JSON, and a 64-bit hash of the values."""
    fields = [(f.name, f.dataType) for f in df.schema]
    # Adding zero makes one zero of both.
    values = [col(n) + F.lit(0.0).cast(t) if isinstance(t, (T.FloatType, T.DoubleType)) else col(n) for n, t in fields]
    exact = {f"{kind}Format": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" for kind in ("timestamp", "timestampNTZ")}
    text = F.to_json(F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)]), {"ignoreNullFields": "false", "timeZone": "UTC", **exact})
    return F.concat(F.unhex(F.sha2(text, 256)), F.unhex(F.lpad(F.hex(F.xxhash64(*values)), 16, "0")))
