"""Cleaning steps: drop or fill missing values, trim, rename, convert."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import (
    col,
    groupable_columns,
    is_integer_text,
    is_missing,
    is_number_text,
    is_unsigned_text,
    literal_of,
    numeric_columns,
    present,
    quoted,
    standard_name,
    string_columns,
    strip,
    to_double,
    to_long,
    to_unsigned,
)
from ..functions.names import distinct_names
from .distinct import value_counts
from .heavy import heavy_modes
from .probe import maybe_numeric
from .statistics import approximate_medians, exact_medians


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with any missing value, in any column or in the given ones."""
    return df.na.drop("any", subset=[quoted(n) for n in (df.columns if columns is None else columns)])


def missing_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """The columns that have a missing value; copies of rows do not change the answer."""
    names = df.columns if columns is None else columns
    if not names:
        return []
    gaps = df.agg(*[F.bool_or(is_missing(df.schema[n])) for n in names]).first()
    return [n for n, gap in zip(names, gaps, strict=True) if gap]


def _replace_columns(df: DataFrame, replaced: dict[str, Column]) -> DataFrame:
    return df.select(*[replaced[n].alias(n) if n in replaced else col(n) for n in df.columns])


def fill_with(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Each column with its missing values replaced."""
    fields = {f.name: f for f in df.schema}
    return _replace_columns(df, {n: F.coalesce(present(fields[n]), v) for n, v in values.items()})


def _numeric_gaps(df: DataFrame, columns: list[str] | None) -> list[str]:
    numeric = numeric_columns(df)
    if columns is None:
        return missing_columns(df, numeric)
    return [n for n in numeric if n in columns]


def fill_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill missing numbers with the column's mean; a filled column becomes double.

    The means are one scalar subquery: they are computed once, inside the same query, and share its
    shuffles. Pass `columns` if those with gaps are known, which saves the pass that finds them.
    """
    names = _numeric_gaps(df, columns)
    if not names:
        return df
    return fill_with(df, fill_values(df, "fill_mean", names))


def fill_median(
    df: DataFrame, columns: list[str] | None = None, *, approximate: bool = False, accuracy: int | None = None
) -> DataFrame:
    """Fill missing numbers with the column's median; a filled column becomes double.

    The median is exact and found by `exact_medians`, whose count of values also shows the gaps; or
    with `approximate` it is taken from a sketch of all rows.
    """
    names = [n for n in numeric_columns(df) if columns is None or n in columns]
    if not names:
        return df
    if approximate:
        more = {} if accuracy is None else {"accuracy": accuracy}
        names = missing_columns(df, names) if columns is None else names
        medians = approximate_medians(df, names, **more) if names else {}
    else:
        medians = exact_medians(df, names, gaps_only=columns is None)
    return fill_with(df, {n: F.lit(m).cast("double") for n, m in medians.items()}) if medians else df


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the most frequent value of each column, the smallest on ties, as fields c0, c1, …

    All columns are counted in one scan, spread over the values; a column's winner is kept as a
    running minimum, so no task gathers the values of a column.
    """
    counted, kinds = value_counts(df, columns)
    values = [f"v{k}" for k in range(max(kinds) + 1)]
    best = counted.groupBy("position").agg(
        F.min_by(F.struct(*values), F.struct(-F.col("occurrences"), *[F.col(v) for v in values])).alias("value")
    )
    at = [
        F.max(F.when(F.col("position") == i, F.col(f"value.v{kinds[i]}"))).alias(f"c{i}") for i in range(len(columns))
    ]
    return best.agg(F.struct(*at))


def fill_mode(df: DataFrame, columns: list[str] | None = None, *, heavy: bool = True) -> DataFrame:
    """Fill missing values of any type with the column's most frequent value, the smallest on ties.

    With `heavy`, values that fill a noticeable share of a column are found by `heavy_modes` in two scans that shuffle
    summaries only, and the values of the other columns are grouped. Without it all are grouped in one scan, as a
    scalar subquery of the same query: for a table that is costly to compute.
    """
    usable = groupable_columns(df)
    names = missing_columns(df, usable) if columns is None else [n for n in usable if n in columns]
    values = fill_values(df, "fill_mode", names, heavy=heavy)
    # Put so that the schema still says that the column may be null.
    return fill_with(df, {n: F.when(present(df.schema[n]).isNull(), v) for n, v in values.items()}) if values else df


def fill_values(df: DataFrame, method: str, names: list[str], *, heavy: bool = True) -> dict[str, Column]:
    """What `method` fills each of the columns with: constants, or fields of a scalar subquery.

    Columns to which the method does not apply, as means to texts, are left out.
    """
    fields = {f.name: f for f in df.schema}
    if method != "fill_mode":
        names = [n for n in numeric_columns(df) if n in names]
    if not names:
        return {}
    if method == "fill_mean":
        means = df.agg(F.struct(*[F.avg(present(fields[n]).cast("double")).alias(f"c{i}") for i, n in enumerate(names)])).scalar()
        return {n: means.getField(f"c{i}") for i, n in enumerate(names)}
    if method == "fill_median":
        return {n: F.lit(m).cast("double") for n, m in exact_medians(df, names).items()}
    if method != "fill_mode":
        raise ValueError(f"method must be fill_mean, fill_median or fill_mode, not {method!r}")
    found = heavy_modes(df, [n for n in groupable_columns(df) if n in names]) if heavy else {}
    values = {n: literal_of(x, fields[n].dataType) for n, x in found.items()}
    if rest := [n for n in groupable_columns(df) if n in names and n not in found]:
        row = modes(df, rest).scalar()
        values |= {n: row.getField(f"c{i}").cast(fields[n].dataType) for i, n in enumerate(rest)}
    return values


def fill_by_chunk(df: DataFrame, method: str, chunk: str = "chunk_id", columns: list[str] | None = None) -> DataFrame:
    """Fill missing values from the rows of the same chunk.

    A chunk has a fixed number of rows, so its group is bounded whatever the table's size.
    """
    window = W.partitionBy(col(chunk))
    kinds = {
        "fill_mean": (numeric_columns(df), lambda c: F.avg(c.cast("double"))),
        "fill_median": (numeric_columns(df), lambda c: F.median(c.cast("double"))),
        "fill_mode": (groupable_columns(df), lambda c: F.mode(c, deterministic=True)),
    }
    if method not in kinds:
        raise ValueError(f"method must be one of {', '.join(kinds)}, not {method!r}")
    eligible, value = kinds[method]
    eligible = [n for n in eligible if n != chunk]
    names = missing_columns(df, eligible) if columns is None else [n for n in eligible if n in columns]
    if not names:
        return df
    fields = {f.name: f for f in df.schema}
    return fill_with(df, {n: value(present(fields[n])).over(window) for n in names})


def trim_whitespace(df: DataFrame, *, null_as: str | None = None) -> DataFrame:
    """Cut whitespace from both ends of every text; `null_as` names the text that nulls become."""
    trimmed = {}
    for n in string_columns(df):
        trimmed[n] = strip(col(n))
        if null_as is not None:
            trimmed[n] = F.coalesce(trimmed[n], F.lit(null_as))
    return _replace_columns(df, trimmed)


def standardize_columns(df: DataFrame, *, on_clash: str = "number") -> DataFrame:
    """Trim and lower-case the column names and turn blanks into underscores.

    Names that become equal are numbered (`number`) or refused (`error`).
    """
    names = [standard_name(n) for n in df.columns]
    numbered = distinct_names(names, "_")
    if on_clash == "error" and numbered != names:
        raise ValueError(f"columns become equal: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*numbered)


@dataclass(frozen=True)
class TextFacts:
    """Which text columns hold numbers only: whole ones, whole ones above the largest bigint, any others."""

    whole: tuple[str, ...] = ()
    fractional: tuple[str, ...] = ()
    unsigned: tuple[str, ...] = ()


def text_fact_columns(texts: dict[str, Column]) -> list[Column]:
    """Aggregates behind `TextFacts`; `texts` gives each column's value at the time of conversion."""
    counts = []
    for i, c in enumerate(texts.values()):
        counts += [
            F.count_if(~is_number_text(c)).alias(f"text{i}"),
            F.count_if(~is_integer_text(c)).alias(f"fraction{i}"),
            F.count_if(~is_unsigned_text(c)).alias(f"signed{i}"),
        ]
    return counts


def number_kind(row, i: int, filled: bool) -> str | None:
    """What the text column with the aggregates `i` holds: whole, unsigned or fractional numbers, or None."""
    if row[f"text{i}"]:
        return None
    if not filled:
        return "fractional"
    return "whole" if row[f"fraction{i}"] == 0 else "unsigned" if row[f"signed{i}"] == 0 else "fractional"


def read_text_facts(texts: dict[str, Column], row) -> TextFacts:
    found = {n: number_kind(row, i, row["filled"][f"c{i}"]) for i, n in enumerate(texts)}
    return TextFacts(**{k: tuple(n for n in texts if found[n] == k) for k in ("whole", "fractional", "unsigned")})


def filled_flags(texts: dict[str, Column]) -> Column:
    """Whether each text column has any value; one with none converts to double."""
    return F.struct(*[(F.count(c) > 0).alias(f"c{i}") for i, c in enumerate(texts.values())]).alias("filled")


def numeric_texts(df: DataFrame, texts: dict[str, Column] | None = None) -> TextFacts:
    """Find the text columns whose every value is a number: a short probe, then one pass."""
    texts = {n: col(n) for n in string_columns(df)} if texts is None else texts
    return facts_and_gaps(df, texts, [])[0]


def facts_and_gaps(df: DataFrame, texts: dict[str, Column], gaps_of: list[str]) -> tuple[TextFacts, list[str]]:
    """What text columns hold, and which of other columns have a missing value, in one pass after a short probe."""
    texts = maybe_numeric(df, texts) if texts else {}
    wanted = [*text_fact_columns(texts), filled_flags(texts)] if texts else []
    wanted += [F.bool_or(is_missing(df.schema[n])).alias(f"gap{i}") for i, n in enumerate(gaps_of)]
    if not wanted:
        return TextFacts(), []
    row = df.agg(*wanted).first()
    facts = read_text_facts(texts, row) if texts else TextFacts()
    return facts, [n for i, n in enumerate(gaps_of) if row[f"gap{i}"]]


def convert_types(df: DataFrame, facts: TextFacts | None = None) -> DataFrame:
    """Turn text columns whose every value is a number into bigint, or double if any has a fraction.

    Whole numbers from 0 to 2^64 - 1 of which some need it become decimals of 20 digits. All other
    columns stay as they are.
    """
    facts = numeric_texts(df) if facts is None else facts
    converted = {n: to_long(col(n)) for n in facts.whole}
    converted |= {n: to_unsigned(col(n)) for n in facts.unsigned}
    converted |= {n: to_double(col(n)) for n in facts.fractional}
    return _replace_columns(df, converted)
