"""Values that fill a noticeable share of a column, found by sketches of a fixed size and proven by an exact count."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import literal_of, present

#: Values that a task's summary keeps of a column, and those that are looked at in the end.
TRACKED, CANDIDATES = 10_000, 64

_SKETCHED = (T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.DateType, T.TimestampType)


def share_error(tracked: int = TRACKED) -> float:
    """The most by which a summary's count of a value may be off, as a share of the rows.

    A frequent-items sketch has room for the next power of two above `tracked` / 0.75 values, and errs by 3.5 over that.
    """
    return 3.5 / (1 << (ceil(tracked / 0.75) - 1).bit_length())


def _comparable(field: T.StructField) -> Column:
    """The value as a sketch may compare it: without NaN, and with one zero."""
    c = present(field)
    return c + F.lit(0.0).cast(field.dataType) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else c


def heavy_modes(df: DataFrame, columns: list[str], *, tracked: int = TRACKED, candidates: int = CANDIDATES) -> dict[str, object]:
    """The most frequent value, the smallest on ties, of those columns that have one frequent enough to be proven.

    A first scan keeps a summary of `tracked` values a column in each task, in the manner of Misra and Gries; only
    these are shuffled. Values whose summary count may be the highest are counted exactly in a second scan. The best of
    them is the mode if it is more frequent than any value may be that the summaries have lost, twice their error: then
    all values as frequent as it have been counted too. Columns without such a value, as keys are, and those of types
    that have no sketch are left out.
    """
    fields = {f.name: f for f in df.schema}
    names = [n for n in columns if isinstance(fields[n].dataType, _SKETCHED)]
    if not names:
        return {}
    values = df.select(*[_comparable(fields[n]).alias(f"c{i}") for i, n in enumerate(names)])
    sketches = [F.expr(f"approx_top_k(c{i}, {candidates}, {tracked})").alias(f"c{i}") for i in range(len(names))]
    row = values.agg(F.count(F.lit(1)).alias("rows"), *sketches).first()
    error = share_error(tracked) * row["rows"]
    asked: list[tuple[int, object]] = []
    for i in range(len(names)):
        found = [x for x in row[f"c{i}"] if x["item"] is not None]
        likely = [x["item"] for x in found if x["count"] >= found[0]["count"] - error]
        if likely and len(row[f"c{i}"]) - len(found) + len(likely) < candidates and found[0]["count"] > 2 * error:
            asked += [(i, x) for x in likely]
    if not asked:
        return {}
    same = [F.col(f"c{i}") == literal_of(x, fields[names[i]].dataType) for i, x in asked]
    counts = values.agg(*[F.count_if(s).alias(f"n{k}") for k, s in enumerate(same)]).first()
    best: dict[str, tuple] = {}
    for (i, x), n in zip(asked, counts, strict=True):
        name = names[i]
        if n > 2 * error and (name not in best or (-n, _order(x)) < best[name][0]):
            best[name] = ((-n, _order(x)), x)
    return {n: x for n, (_, x) in best.items()}


def _order(value: object) -> object:
    """Texts compare by their bytes, as Spark compares them."""
    return value.encode() if isinstance(value, str) else value
