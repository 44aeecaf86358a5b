"""What the operators share: the shared folder, written tables, joins with a counted side, byte views of columns."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager
from functools import cache, reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of narrow keys up to which a counted side is sent to all executors; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or the context's checkpoint folder.

    A cluster must name one. Only a local session that names none, as a test may, gets a temporary one.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"{application}-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None, page_rows: int | None = None) -> DataFrame:
    """The rows of `df`, written as parquet to the shared folder and read from there.

    Later reads neither compute it again nor depend on any one executor. `codec` compresses it otherwise than the session
    does. Whether a page, which is in memory at once, is full is asked after `page_rows` rows, else after 100, which long rows
    want fewer of. `forget` deletes it.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write if page_rows is None else df.write.option("parquet.page.size.row.check.min", page_rows)
    writer.parquet(path, compression=codec)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._llm_path = path
    return read


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that `written` made, once nothing reads them any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "_llm_path", None)):
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def numbered(df: DataFrame, name: str, number: str = "number", order_by: list[Column] | None = None) -> DataFrame:
    """The rows of `df`, written once, with a last column `number`: 1, 2, 3 … in the order of `order_by`, or of no meaning.

    Written rows are counted by the partition they were made in, which then starts where the one before it ends:
    ordering cuts the table into ranges, and no task orders the whole. `forget` deletes the table.
    """
    if order_by is not None:
        df = df.orderBy(*order_by)
    place, part = free_name(df.columns, "place"), free_name(df.columns, "part")
    stored = written(df.withColumn(place, F.monotonically_increasing_id()), name)
    parts = stored.withColumn(part, F.shiftright(place, 33))
    # One row for each partition.
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sizes = parts.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))
    starts = sizes.select(part, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(number))
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = parts.join(counted(starts), part).withColumn(number, F.col(number) + within).select(*(quoted(c) for c in df.columns), number)
    out._llm_path = stored._llm_path
    return out


@contextmanager
def _held(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batch_rows(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Arrow batches of at most so many rows for what is run inside: long rows need little memory then, in the JVM too."""
    return _held(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def scan_rows(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Parquet is read at most so many rows at a time by what is run inside; by default a file of long rows may be one batch."""
    return _held(spark, "spark.sql.parquet.columnarReaderBatchSize", rows)


def counted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, to be broadcast if it is counted to have at most `most` rows, else to be shuffled.

    Meant for written tables of a few numbers a row, whose count costs next to nothing.
    """
    return F.broadcast(df) if df.count() <= most else df


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """All of the names equal, nulls equal to each other."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: list[str], name: str) -> str:
    """`name`, with as many underscores before it as no column of the table has, in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def utf8(column: Column) -> Column:
    return F.encode(F.coalesce(column, F.lit("")), "UTF-8")


def trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, at whose end a worker gives free memory back to the system.

    Workers live on from stage to stage: what the blocks of one took would else stay beside what the next one takes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return run


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
           fields: list[tuple[str, str | T.DataType]]) -> DataFrame:
    """`mapInArrow` by the places of columns, whose names may hold any character; `fields` are names and types."""
    inner = [f"c{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=inner)

    types = [kind if isinstance(kind, T.DataType) else T.DataType.fromDDL(kind) for _, kind in fields]
    schema = T.StructType([T.StructField(i, kind) for i, kind in zip(inner, types, strict=True)])
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(trimmed(run), schema).toDF(*(name for name, _ in fields))


def kinds(df: DataFrame, places: Iterable[int] | None = None) -> list[tuple[str, str | T.DataType]]:
    """Names and types of the columns at these places, or of all."""
    all_fields = df.schema.fields
    return [(all_fields[i].name, all_fields[i].dataType) for i in (range(len(all_fields)) if places is None else places)]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without copying them, and where each value begins and the last ends."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def pieces(offsets: np.ndarray, most_bytes: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes and rows; a longer row is a run of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), start + most_rows, rows)
        yield start, end
        start = end


def counter_rows(counters: np.ndarray, blocks: int) -> pa.RecordBatch:
    """A task's counters as rows (block int, counts binary), for `added_up`."""
    rows = counters.astype(np.int64).reshape(blocks, -1)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(blocks), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "counts"]
    )


COUNTER_SCHEMA = "block int, counts binary"


def added_up(partial: DataFrame, blocks: int, size: int) -> np.ndarray:
    """The sum of all tasks' counters: a fixed number, whatever the table's size. Each block is summed row by row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts.as_py(), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"]
            )

    total = np.zeros((blocks, size // blocks), np.int64)
    for row in partial.repartition("block").mapInArrow(add, COUNTER_SCHEMA).collect():
        total[row.block] = np.frombuffer(row.counts, np.int64)
    return total.ravel()
