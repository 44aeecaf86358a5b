"""Cleaning a table: all chosen steps in their fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import col, string_columns, strip
from ..functions.missing import is_missing
from ..functions.names import distinct_names
from ..operators.cleaning import (
    TextFacts,
    convert_types,
    drop_missing,
    facts_and_gaps,
    fill_by_chunk,
    fill_mean,
    fill_median,
    fill_mode,
    standardize_columns,
    trim_whitespace,
)
from ..operators.distinct import remove_duplicates
from ..options import FILL_METHODS, CleanOptions
from ..sources.csv import write_csv
from ..sources.files import materialized
from ..sources.order import with_chunk, with_row_index

_ROW, _CHUNK = "__row", "__chunk"
_FILLS = {"fill_mean": fill_mean, "fill_median": fill_median, "fill_mode": fill_mode}


def decisions(df: DataFrame, options: CleanOptions) -> tuple[TextFacts | None, list[str] | None]:
    """Which text columns are numbers and which columns have gaps, as far as the options need them, in one pass.

    Copies of rows change neither, nor do fill values, which the column holds already. So this looks
    at the table before both and shuffles nothing.
    """
    filling = options.handle_missing in FILL_METHODS
    texts = {}
    if options.convert_types:
        df = drop_missing(df) if options.handle_missing == "drop" else df
        texts = {n: strip(col(n)) if options.trim_whitespace else col(n) for n in string_columns(df)}
    facts, gaps = facts_and_gaps(df, texts, df.columns if filling else [])
    return (facts if options.convert_types else None), (gaps if filling else None)


def clean(
    df: DataFrame,
    options: CleanOptions | None = None,
    *,
    order_by: str | None = None,
    counts: dict[str, Observation] | None = None,
    fill_columns: list[str] | None = None,
    **chosen,
) -> DataFrame:
    """Clean a table: duplicates, names, missing values, trim, types, each if chosen.

    Two facts about the data shape the result: which columns have gaps, and which text columns are
    numbers. Both are looked up at once in one pass without a shuffle; the cleaning itself is lazy,
    but for medians after dedup, for which the distinct rows are written to the shared folder once.
    `order_by` names a column that places the rows and takes no part in the cleaning; of equal rows
    the first stays. With `scope="chunk"` fill values come from runs of `chunk_rows` rows, placed by
    `order_by` (then a dense row number) or else in scan order; duplicates are then not removed, as
    fill values would depend on which copies stay. `fill_columns` names those to fill, if not all.
    `counts` observes `rows` of those `read` and of
    those that are `distinct`; not for fill values, which read the rows more than once.
    """
    options = CleanOptions.from_dict(chosen) if options is None else options
    by_chunk = options.scope == "chunk" and options.handle_missing in FILL_METHODS
    if by_chunk and options.remove_duplicates:
        raise ValueError("remove_duplicates needs scope='table'")

    carried = [order_by] if order_by is not None else []
    body = df.drop(*carried) if carried else df
    given = body.columns
    if options.standardize_columns:
        # Names are numbered against the one that stays as it is.
        body_names = distinct_names([*carried, *standardize_columns(body).columns], "_")[len(carried) :]
        names = iter(body_names)
        df = df.toDF(*[n if n in carried else next(names) for n in df.columns])
        body = body.toDF(*body_names)
    facts, gaps = decisions(body, options)
    if fill_columns is not None and gaps is not None:
        renamed = dict(zip(given, body.columns, strict=True))
        gaps = [n for n in gaps if n in {renamed[c] for c in fill_columns}]
    if counts:
        df = df.observe(counts["read"], F.count(F.lit(1)).alias("rows"))

    if by_chunk:
        out = _filled_by_chunk(df, options, order_by, gaps)
    else:
        out = df
        if options.remove_duplicates:
            out = remove_duplicates(df, strategy=options.dedup_strategy, order_by=order_by)
            if gaps and options.handle_missing == "fill_median":
                # Medians take several passes; each would shuffle the whole table again.
                out = materialized(out)
        if counts:
            out = out.observe(counts["distinct"], F.count(F.lit(1)).alias("rows"))
        if options.handle_missing == "drop":
            out = drop_missing(out, body.columns)
        elif gaps is not None:
            # After dedup the fill shares its shuffle; looking for frequent values first would shuffle again.
            how = {"heavy": not options.remove_duplicates} if options.handle_missing == "fill_mode" else {}
            out = _FILLS[options.handle_missing](out, gaps, **how)
    if options.trim_whitespace:
        out = trim_whitespace(out)
    return convert_types(out, facts) if facts else out


def _filled_by_chunk(df: DataFrame, options: CleanOptions, order_by: str | None, gaps: list[str]) -> DataFrame:
    numbered = df if order_by is not None else with_row_index(df, name=_ROW)
    chunked = with_chunk(numbered, order_by or _ROW, chunk_rows=options.chunk_rows, name=_CHUNK)
    return fill_by_chunk(chunked, options.handle_missing, _CHUNK, gaps).drop(_CHUNK, _ROW)


def clean_summary(df: DataFrame, options: CleanOptions | None = None, **chosen) -> DataFrame:
    """One row of counters: rows in, after duplicates, out, and what each step removed.

    Rows are grouped once; a group's size gives the copies and its key tells whether it is dropped.
    """
    options = CleanOptions.from_dict(chosen) if options is None else options
    one = F.lit(1)
    if options.remove_duplicates:
        rows = df.groupBy(*[col(n) for n in df.columns]).agg(F.count(one).alias("__copies"))
        rows_in = F.coalesce(F.sum("__copies"), F.lit(0))
    else:
        rows, rows_in = df, F.count(one)
    kept = F.count(one)
    if options.handle_missing == "drop":
        gaps = F.array(*[is_missing(field) for field in df.schema])
        kept = F.count_if(~F.array_contains(gaps, True))
    counted = rows.agg(rows_in.alias("rows_in"), F.count(one).alias("rows_after_dedup"), kept.alias("rows_out"))
    return counted.select(
        "*",
        (F.col("rows_in") - F.col("rows_after_dedup")).alias("duplicates_removed"),
        (F.col("rows_after_dedup") - F.col("rows_out")).alias("missing_removed"),
    )


@dataclass(frozen=True)
class CleanResult:
    """What a cleaning run did: rows after duplicates, rows written, and the rows that the steps removed."""

    output_path: str
    rows_processed: int
    rows_out: int
    columns: tuple[str, ...]
    rows_removed: int = 0
    duplicates_removed: int = 0
    missing_removed: int = 0


def clean_to_csv(
    df: DataFrame, path: str, options: CleanOptions | None = None, *, mode: str = "error", **chosen
) -> CleanResult:
    """Clean and write as CSV. Rows are counted while they are read, after duplicates, and while they are written.

    A failure is raised; a folder without `_SUCCESS` was not finished.
    """
    options = CleanOptions.from_dict(chosen) if options is None else options
    several = options.handle_missing in FILL_METHODS  # fill values read the rows once more
    seen, counts = Observation(), {"read": Observation(), "distinct": Observation()}
    cleaned = clean(df, options, counts=None if several else counts)
    write_csv(cleaned.observe(seen, F.count(F.lit(1)).alias("rows")), path, mode=mode)
    rows_out = seen.get["rows"]
    # Fill values remove no rows, so only the rows before are counted.
    rows_in = df.count() if several else counts["read"].get["rows"]
    processed = rows_out if several else counts["distinct"].get["rows"]
    return CleanResult(
        path, processed, rows_out, tuple(cleaned.columns), rows_in - rows_out, rows_in - processed, processed - rows_out
    )
