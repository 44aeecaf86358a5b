"""CSV files in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import as_missing, col, csv_header_names
from . import quoted as parts

#: Files with quoted line breaks that are told apart from the others by name.
LISTED_FILES = 1_000
_RECORD, _PLACE = "__record", "__place"
READ_OPTIONS = {
    "header": True,
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": _RECORD,
    "columnPruning": False,  # a parser that skips columns no longer sees how wide a row is
}


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _first_file(spark: SparkSession, paths: list[str]) -> str:
    names = spark.read.format("binaryFile").load(paths).filter("length > 0")
    first = names.agg(F.min("path")).first()[0]
    if first is None:
        raise ValueError(f"no data in {paths}")
    return first


def _header_fields(spark: SparkSession, paths: list[str], separator: str) -> list[str | None]:
    reader = spark.read.options(header=False, escape='"', multiLine=True, sep=separator)
    return list(reader.csv(_first_file(spark, paths)).first())


def header_names(spark: SparkSession, path: str | Sequence[str], *, separator: str = ",") -> list[str]:
    """Column names of the first file: blank and repeated names are made distinct."""
    return _names(_header_fields(spark, _paths(path), separator))


def _names(fields: list[str | None]) -> list[str]:
    first = fields[0].removeprefix("\ufeff") if fields[0] else fields[0]
    return csv_header_names([first, *fields[1:]])


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines as the files hold them, cut at line feeds only."""
    return spark.read.option("lineSep", "\n").text(paths)


def _line_end(spark: SparkSession, paths: list[str]) -> str:
    """What ends the header line of the first file."""
    first = _lines(spark, [_first_file(spark, paths)]).first()
    return "\r\n" if first is not None and first[0].endswith("\r") else "\n"


def _check_headers(spark: SparkSession, paths: list[str]) -> None:
    """Raise unless the first lines of all files are equal. Only the first block of each file is read."""
    block = F.col("_metadata.file_block_start")
    lines = _lines(spark, paths).filter(block == 0).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("place")
    )
    firsts = lines.groupBy("file").agg(F.min_by(F.regexp_replace("value", "^\ufeff", ""), "place").alias("line"))
    if firsts.select("line").distinct().limit(2).count() > 1:
        raise ValueError(f"files with different headers in {paths}")


def _surplus_fields(names: list[str], separator: str) -> Column:
    """True where the raw record holds more fields than the header.

    Spark keeps the raw record of every row whose width differs. A short row always lacks its last
    column, so a filled last column decides at once; otherwise the separators outside quotes do.
    """
    unquoted = F.regexp_replace(_RECORD, '"[^"]*"', "")
    separators = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(separator), F.lit("")))
    too_long = col(names[-1]).isNotNull() | (separators >= len(names))
    return F.col(_RECORD).isNotNull() & too_long


def with_record(schema: T.StructType) -> T.StructType:
    """The schema with the column in which Spark keeps records of another width."""
    return T.StructType([*schema.fields, T.StructField(_RECORD, T.StringType())])


def handle_bad_lines(df: DataFrame, names: list[str], bad_lines: str, separator: str = ",") -> DataFrame:
    """Drop rows of text columns with more fields than `names`, or fail the query that meets one."""
    surplus = _surplus_fields(names, separator)
    if bad_lines == "skip":
        kept = ~surplus
    elif bad_lines == "error":
        message = F.concat(F.lit(f"more than {len(names)} fields: "), F.substring(_RECORD, 1, 200))
        kept = F.when(surplus, F.raise_error(message).cast("boolean")).otherwise(True)
    else:
        raise ValueError(f"bad_lines must be 'skip' or 'error', not {bad_lines!r}")
    return df.filter(kept).drop(_RECORD)


def stream_records(lines: DataFrame, names: list[str], *, separator: str = ",", line_end: str | None = None) -> DataFrame:
    """The text columns `names`, and the record of rows of another width, of a stream of lines of files.

    Lines are joined to records within a block of a file; a record that leaves its block fails the query, as the next
    block may be read by another task. So does a file whose header is not `names`. Without `line_end` lines end with a
    line feed, with or without a carriage return before it.
    """
    schema = with_record(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    states = parts.with_states(parts.placed(lines), separator)
    rows = parts.records(states, line_end or "\n", {}, crossing=False)
    rows = rows.filter((F.col("kind") == parts.HEADER) | F.col("text").rlike(r"[^\x00-\x20]"))
    if line_end is None:
        rows = rows.withColumn("text", F.regexp_replace("text", "\r$", ""))
    is_header = F.col("kind") == parts.HEADER
    rows = rows.withColumn("text", F.when(is_header, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text")))
    rows = rows.withColumns({"__kind": F.col("kind"), "__text": F.col("text")})
    parsed = _parsed(rows, schema, {"sep": separator}, keep=["__kind", "__text"])
    is_header = F.col("__kind") == parts.HEADER
    named = F.col(_RECORD).isNull()
    for n in names:
        named = named & F.coalesce(col(n) == n, F.lit(False))
    message = F.concat(F.lit(f"a header other than {separator.join(names)}: "), F.substring("__text", 1, 200))
    row = F.when(is_header & ~named, F.raise_error(message).cast("boolean")).otherwise(~is_header)
    return parsed.filter(row).select(*(col(n) for n in names), _RECORD)


def _parsed(texts: DataFrame, schema: T.StructType, options: dict, keep: list[str]) -> DataFrame:
    """The columns of the records in `text`, and the columns `keep`."""
    how = {k: str(v) for k, v in (READ_OPTIONS | options).items() if k not in ("header", "columnPruning")}
    kept = {n: f"__kept{i}" for i, n in enumerate(keep)}
    rows = texts.select(F.from_csv("text", schema.toDDL(), how).alias("__row"), *(F.col(n).alias(k) for n, k in kept.items()))
    return rows.select("__row.*", *(F.col(k).alias(n) for n, k in kept.items()))


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    multi_line: bool | None = None,
    bad_lines: str = "error",
    na: bool = True,
    separator: str = ",",
    position: str | None = None,
    listed_files: int = LISTED_FILES,
) -> DataFrame:
    """Every column of a CSV file, or of a folder of them with the same header, as text.

    `multi_line` None looks for quoted line breaks first. Files without any are parsed line by line; the others stay
    split too, and their blocks are cut into records by the state, inside or outside a field, that each begins in.
    If more than `listed_files` files have line breaks, all are read in that way. False skips the look, and True
    makes each file one task. `bad_lines` decides on rows with more fields
    than the header: `skip` drops them, `error` fails the query that meets one. Short rows are padded
    with nulls. `na` turns the missing-value tokens into nulls. `position` names a column to add that
    orders the rows by file, block and place in the block, whatever order Spark packs the files in.

    All files must have the header of the first one, and end their lines as it does. Where lines end
    with a carriage return and a line feed, either alone is part of a quoted field.
    """
    paths = _paths(path)
    header = _header_fields(spark, paths, separator)
    names = _names(header)
    if header != names:
        _check_headers(spark, paths)  # else Spark compares the names itself
    options = {"sep": separator, "enforceSchema": header != names}
    if (ends := _line_end(spark, paths)) != "\n":
        options["lineSep"] = ends
    schema = with_record(T.StructType([T.StructField(n, T.StringType()) for n in names]))

    def read(whole: bool) -> DataFrame:
        df = spark.read.schema(schema).options(**READ_OPTIONS, **options, multiLine=whole).csv(paths)
        if position is None:
            return df
        return df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start").alias(_PLACE))

    blocks = parts.look(spark, paths, separator, ends, listed_files) if multi_line is None else parts.Blocks([])
    if blocks.broken == []:
        df = read(bool(multi_line))
    else:
        if header == names:
            _check_headers(spark, paths)
        records = parts.whole_records(spark, paths, separator, ends, blocks)
        records = records.withColumn(_PLACE, F.struct(F.col("file").alias("file_path"), F.col("block").alias("file_block_start")))
        df = _parsed(records, schema, {"sep": separator}, keep=[] if position is None else [_PLACE])
        if blocks.broken is not None:
            # Spark does not open the files that such a filter rules out.
            df = df.unionByName(read(False).filter(~F.col("_metadata.file_path").isin(blocks.broken)))

    df = handle_bad_lines(df, names, bad_lines, separator)
    kept = [as_missing(col(n)).alias(n) if na else col(n) for n in names]
    if position is not None:
        # Numbered after bad lines are gone: the rows of a block have consecutive numbers.
        place = [F.col(f"{_PLACE}.file_path").alias("file"), F.col(f"{_PLACE}.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
        kept.append(F.struct(*place).alias(position))
    return df.select(*kept)


def write_csv(df: DataFrame, path: str, *, mode: str = "error", order_by: str | None = None) -> None:
    """Write with a header, nulls as empty fields, booleans as `True` and `False`.

    The result is a folder that appears as a whole or not at all. With `order_by` rows are
    range-partitioned by it, ties by their place in the input, so that a frequent key is split; the
    part files in name order hold the rows in that order. A missing value of a table of one column is
    written as `""`, as a blank line would be no row.
    """
    if order_by is not None:
        arrival = "__arrival"
        placed = df.withColumn(arrival, F.monotonically_increasing_id())
        df = placed.orderBy(col(order_by), col(arrival)).drop(arrival)
    printed = [
        F.initcap(col(f.name).cast("string")).alias(f.name)
        if isinstance(f.dataType, T.BooleanType)
        else col(f.name)
        for f in df.schema
    ]
    # Blanks at the ends of a text are data; Spark's writer would cut them.
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if len(printed) == 1:
        name = df.columns[0]
        printed = [F.coalesce(printed[0].cast("string"), F.lit("")).alias(name)]
    else:
        options["emptyValue"] = ""
    df.select(*printed).write.mode(mode).options(**options).csv(path)
