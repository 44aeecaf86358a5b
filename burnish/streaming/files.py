"""File streams: scan, clean, dedup, running totals, per-batch fills."""

from __future__ import annotations

from collections import defaultdict
from threading import Event
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import col, is_number_text, normalize_na, numeric_columns, present, row_digest, standard_name
from ..functions.names import distinct_names
from ..operators.cleaning import drop_missing, trim_whitespace
from ..operators.counts import column_missing, one_row_per_column, table_counts
from ..options import FILL_METHODS, CleanOptions
from ..plans.cleaning import clean
from ..sources.csv import READ_OPTIONS, handle_bad_lines, stream_records, with_record

_BATCH = "batch_id"
_OBSERVED = "burnish_rows_"


def stream_scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    *,
    file_format: str = "csv",
    file_names: str | None = None,
    max_files_per_trigger: int | None = None,
    multi_line: bool = False,
    line_end: str | None = None,
    bad_lines: str = "error",
    misfits: str = "error",
    na: bool = True,
) -> DataFrame:
    """Files below the folder `path` as a stream, those whose names match the glob `file_names`; `path` may be a glob itself.

    For CSV every file's header must be the names of `schema`. `bad_lines` and `na` are those of `scan_csv`. Fields may
    have line breaks: lines are joined to records within a block of a file (`spark.sql.files.maxPartitionBytes`), and a
    record that leaves its block fails the query, as a stream cannot read its files beforehand. `multi_line` reads a
    file in one task instead. `line_end="\\r\\n"` is for lines that end so where fields have plain line feeds.
    Values of other types than text are
    read as text and cast; one that does not fit fails the query (`misfits="error"`) or becomes null (`"null"`).
    """
    options = {}
    if file_names is not None:
        options["pathGlobFilter"] = file_names
    if max_files_per_trigger is not None:
        options["maxFilesPerTrigger"] = max_files_per_trigger
    if file_format != "csv":
        return spark.readStream.schema(schema).format(file_format).options(**options).load(path)

    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if multi_line:
        if line_end is not None:
            options["lineSep"] = line_end
        texts = T.StructType([T.StructField(n, T.StringType()) for n in declared.names])
        reader = spark.readStream.schema(with_record(texts)).format("csv")
        stream = reader.options(**READ_OPTIONS, **options, enforceSchema=False, multiLine=True).load(path)
    else:
        lines = spark.readStream.options(**options, lineSep=line_end or "\n").text(path)
        stream = stream_records(lines, declared.names, line_end=line_end)
        # The source counts lines, headers among them.
        stream = stream.observe(f"{_OBSERVED}{uuid4().hex}", F.count(F.lit(1)).alias("rows"))
    stream = handle_bad_lines(stream, declared.names, bad_lines)
    stream = normalize_na(stream) if na else stream
    return stream.select(*[_typed(f, misfits).alias(f.name) for f in declared])


def _typed(field: T.StructField, misfits: str) -> Column:
    c = col(field.name)
    if isinstance(field.dataType, T.StringType):
        return c
    return _checked(c, c.try_cast(field.dataType), field.name, misfits)


def _checked(c: Column, value: Column, name: str, misfits: str) -> Column:
    """The cast value; a text that has none is null, or fails the query."""
    if misfits == "null":
        return value
    if misfits != "error":
        raise ValueError(f"misfits must be 'error' or 'null', not {misfits!r}")
    message = F.concat(F.lit(f"no value for {name}: "), F.substring(c, 1, 200))
    fits = c.isNull() | (c == "") | value.isNotNull()
    return F.when(fits, value).otherwise(F.raise_error(message))


def _as_type(c: Column, dtype: str) -> Column:
    return F.when(is_number_text(c), c.try_cast(dtype)) if dtype in ("double", "bigint") else c.try_cast(dtype)


def stream_clean(
    stream: DataFrame,
    options: CleanOptions | None = None,
    *,
    types: dict[str, str] | None = None,
    misfits: str = "null",
    **chosen,
) -> DataFrame:
    """The cleaning steps that need one row only: names, drop, trim and casts.

    A stream cannot know whether all values of a column are numbers, so `types` says what to cast. A value that does
    not fit becomes null; `misfits="error"` fails the query instead, and `"count"` adds the column `misfits` with
    the number of such values in the row, which `stream_profile` and other totals can sum. Fills need a batch
    (`stream_batch_fill`), duplicates a state (`stream_dedup`).
    """
    options = CleanOptions.from_dict(chosen) if options is None else options
    if options.handle_missing in FILL_METHODS:
        raise ValueError("use stream_batch_fill for fill values")
    if options.remove_duplicates:
        raise ValueError("use stream_dedup for duplicates")
    out = stream
    if options.standardize_columns:
        out = out.toDF(*distinct_names([standard_name(n) for n in out.columns], "_"))
    if options.handle_missing == "drop":
        out = drop_missing(out)
    if options.trim_whitespace:
        out = trim_whitespace(out)
    types = types or {}
    rule = "null" if misfits == "count" else misfits
    cast = {n: _checked(col(n), _as_type(col(n), types[n]), n, rule).alias(n) for n in out.columns if n in types}
    lost = []
    if misfits == "count":
        texts = [(col(n), _as_type(col(n), types[n])) for n in cast]
        flags = [(c.isNotNull() & (c != "") & value.isNull()).cast("bigint") for c, value in texts]
        lost = [sum(flags, F.lit(0).cast("bigint")).alias("misfits")]
    return out.select(*[cast.get(n, col(n)) for n in out.columns], *lost)


def stream_profile(stream: DataFrame) -> DataFrame:
    """Missing count and share per column so far; write it with `stream_totals`.

    Each batch is folded within its tasks before it meets the state, which is a single row.
    """
    return column_missing(stream)


def stream_table_counts(stream: DataFrame) -> DataFrame:
    """Rows, cells and missing cells so far, in one row; write it with `stream_totals`."""
    return table_counts(stream)


def stream_statistics(stream: DataFrame) -> DataFrame:
    """Filled rows, mean, deviation, minimum and maximum so far per numeric column; write it with `stream_totals`.

    The state is one row of moments: number, mean and sum of squared distances from it. They are merged around the
    common mean, so that a small spread far from zero is not lost, as it is in sums of squares.
    """
    names = numeric_columns(stream)
    if not names:
        raise ValueError("no numeric columns")
    aggregates, facts = [], {}
    for i, n in enumerate(names):
        value = present(stream.schema[n]).cast("double")
        found = {"filled": F.count(value), "mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value)}
        aggregates += [c.alias(f"{k}{i}") for k, c in found.items()]
        facts[n] = {k: f"{k}{i}" for k in found}
    return one_row_per_column(stream.agg(*aggregates), facts)


def stream_dedup(
    stream: DataFrame, *, event_time: str | None = None, delay: str | None = None, salts: int = 8, key: str = "rows"
) -> DataFrame:
    """The first of each group of equal rows.

    Without a time column every distinct row stays in the state, as whole-table dedup must. With
    `event_time` and `delay` a row is forgotten once the watermark has passed it, so the state is
    bounded by the rows of that span; copies further apart are kept.

    A streaming dedup shuffles every copy to one task. As one row may fill a large share of a batch,
    `salts` spreads its copies over that many tasks, which pass on one each; a row's state is kept
    once more per salt it was seen with. 1 saves that state where no row is frequent.

    `key="digest"` keeps 40 bytes of a row in the state instead of the row, for wide rows: its SHA-256 and a 64-bit hash
    of another kind. Rows with the same digest are taken for copies without being compared. Zeros of both signs are
    equal, as are all NaN.
    """
    if key not in ("rows", "digest"):
        raise ValueError(f"key must be 'rows' or 'digest', not {key!r}")
    if event_time is not None and delay is None:
        raise ValueError("event_time needs a delay such as '10 minutes'")

    names = stream.columns

    def once(rows: DataFrame) -> DataFrame:
        of = rows.columns if key == "rows" else [c for c in rows.columns if c not in names]
        return rows.dropDuplicates(of) if event_time is None else rows.dropDuplicatesWithinWatermark(of)

    if event_time is not None:
        stream = stream.withWatermark(event_time, delay)
    if key == "digest":
        stream = stream.withColumn("__digest", row_digest(stream))
    if salts > 1:
        salt = F.pmod(F.spark_partition_id(), F.lit(salts))
        stream = once(stream.withColumn("__salt", salt)).drop("__salt")
    return once(stream).drop("__digest")


def stream_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is there now to `path`, each file exactly once."""
    _counter(stream.sparkSession)
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start(path)


def stream_batch_fill(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    options: CleanOptions | None = None,
    *,
    types: dict[str, str] | None = None,
    fill_columns: list[str] | None = None,
    **chosen,
) -> StreamingQuery:
    """Clean each micro-batch as a table of its own: fill values come from the batch.

    A batch is written to its own folder and replaces it when Spark repeats the batch. All folders have the same
    columns and types, whatever their batch holds: where means or medians are filled in, numbers are double, those
    in `fill_columns` (by their names before cleaning) or all. Name them if other columns hold whole numbers above
    2^53, such as ids: columns that are not named keep their type and their gaps. `types` says what to cast before,
    as in `stream_clean`. What one batch cannot know of the others is refused: `convert_types`.
    """
    options = CleanOptions.from_dict(chosen) if options is None else options
    if options.convert_types:
        raise ValueError("a batch does not know the values of the others: name the types with `types`")
    _counter(stream.sparkSession)
    if types:
        stream = stream_clean(stream, types=types)
    filling = options.handle_missing in ("fill_mean", "fill_median")
    unknown = set(fill_columns or ()) - set(numeric_columns(stream))
    if unknown:
        raise ValueError(f"no numeric columns: {sorted(unknown)}")
    doubles = [n for n in numeric_columns(stream) if filling and (fill_columns is None or n in fill_columns)]

    def write(batch: DataFrame, batch_id: int) -> None:
        typed = batch.select(*[col(n).cast("double").alias(n) if n in doubles else col(n) for n in batch.columns])
        batch = typed.persist()  # it is read for gaps, for fill values and to be written
        try:
            cleaned = clean(batch, options, fill_columns=fill_columns)
            cleaned.write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()


def stream_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write running totals, such as `stream_profile`, after each micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")

    _counter(totals.sparkSession)
    writer = totals.writeStream.foreachBatch(write).outputMode("complete").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals written by `stream_totals`; the folders of earlier batches are listed, and none is read."""
    totals = spark.read.parquet(path)
    newest = totals.select(F.max(_BATCH)).scalar()
    return totals.filter(F.col(_BATCH) == newest).drop(_BATCH)


class _RowCounter(StreamingQueryListener):
    """Adds up the input rows of every batch of the queries that this module starts."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = defaultdict(int)
        self.ended: dict[str, Event] = defaultdict(Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        observed = [m["rows"] for name, m in event.progress.observedMetrics.items() if name.startswith(_OBSERVED)]
        self.rows[str(event.progress.runId)] += sum(observed) if observed else event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()


_COUNTERS: dict[str, _RowCounter] = {}


def _counter(spark: SparkSession) -> _RowCounter:
    """The session's counter; a query only tells those that listen when it starts."""
    key = spark.sparkContext.applicationId
    if key not in _COUNTERS:
        _COUNTERS[key] = _RowCounter()
        spark.streams.addListener(_COUNTERS[key])
    return _COUNTERS[key]


def rows_read(query: StreamingQuery, *, wait_seconds: float = 60) -> int:
    """Input rows so far of a query that this module has started; all of them once it has ended."""
    counter = _counter(SparkSession.active())
    run = str(query.runId)
    if not query.isActive and not counter.ended[run].wait(wait_seconds):
        raise TimeoutError(f"the end of query {run} was not reported")
    return counter.rows[run]
