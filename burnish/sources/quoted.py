"""CSV records with quoted line breaks, from files that stay split.

A line maps the state it begins in, outside or inside a quoted field, to the state it ends in, and so does a block of a
file. These maps compose, so a first pass gives each block its map, a running composition over the blocks of a file
the state that each begins in, and a second pass cuts every block into records on its own. What a record has in several
blocks is put together after that. Only the lines that hold a quote need a look at their characters, in generated code;
Python composes flags and joins lines a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import materialized

#: What a row of `_records` is: a whole record, a part that ends, goes through or begins one, the header or its part.
WHOLE, ENDS, THROUGH, BEGINS, HEADER, HEADER_BEGINS = range(6)


def quote_state(line: Column, separator: str, *, inside: bool) -> Column:
    """1 if a line that begins inside or outside a quoted field ends inside one, else 0.

    A quote opens a field at its start only, two in a row inside a field are one of its characters, and after the
    closing one the field goes on unquoted up to the separator.
    """
    # The text before each quote; a field begins where the line does.
    before = F.split(line if inside else F.concat(F.lit(separator), line), '"', -1)
    before = F.slice(before, 1, F.size(before) - 1)
    outside_state, inside_state, closed = 0, 1, 2

    def after(state: Column, text: Column) -> Column:
        return (
            F.when(state == inside_state, closed)
            .when((state == closed) & (text == ""), inside_state)
            .when(text.endswith(separator), inside_state)
            .otherwise(outside_state)
        )

    last = F.aggregate(before, F.lit(inside_state if inside else outside_state), after)
    return F.when(F.contains(line, F.lit('"')), F.when(last == inside_state, 1).otherwise(0)).otherwise(int(inside))


def with_states(lines: DataFrame, separator: str) -> DataFrame:
    """`lines` (value and more) with `from_out` and `from_in`: the states after each line."""
    return lines.withColumns({
        "from_out": quote_state(F.col("value"), separator, inside=False),
        "from_in": quote_state(F.col("value"), separator, inside=True),
    })


def lines_of(spark: SparkSession, paths: list[str], line_end: str) -> DataFrame:
    """value, file, block, size: lines of the files, each file cut into blocks as Spark likes."""
    return placed(spark.read.option("lineSep", line_end).text(paths))


def placed(lines: DataFrame) -> DataFrame:
    at = {"file": "file_path", "block": "file_block_start", "size": "file_block_length"}
    return lines.select("value", *(F.col(f"_metadata.{name}").alias(alias) for alias, name in at.items()))


def composed(from_out: np.ndarray, from_in: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """The state before each of the lines, and after the last, if the first begins in `start`."""
    fixed = from_out == from_in  # ends alike from either state; else the state stays or is swapped
    swaps = np.concatenate([[0], np.cumsum(~fixed & (from_out == 1))])
    last = np.maximum.accumulate(np.concatenate([[0], np.where(fixed, np.arange(1, len(fixed) + 1), 0)]))
    base = np.concatenate([[start], from_out])[last]
    states = base ^ ((swaps - swaps[last]) & 1)
    return states[:-1], int(states[-1])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows of the same block (file and start): key and rows."""
    if not batch.num_rows:
        return
    files = batch.column("file").dictionary_encode()
    file, block = files.indices.to_numpy(), batch.column("block").to_numpy()
    edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        yield (files.dictionary[int(file[a])].as_py(), int(block[a])), batch.slice(a, b - a)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: its map, and how many of its lines end inside a field that they begin outside of."""
    found: dict[tuple, list[int]] = {}
    for batch in batches:
        for key, rows in _blocks(batch):
            from_out, from_in = (rows.column(n).to_numpy().astype(np.int64) for n in ("from_out", "from_in"))
            before = found.get(key, [0, 1, 0])
            found[key] = [composed(from_out, from_in, s)[1] for s in before[:2]] + [before[2] + int(from_out.sum())]
    if found:
        columns = [[f for f, _ in found], [b for _, b in found], *map(list, zip(*found.values(), strict=True))]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "from_out", "from_in", "opens"])


@dataclass
class Blocks:
    """Which files have quoted line breaks, and which of their blocks begin inside a quoted field."""

    broken: list[str] | None
    open_at: dict[str, set[int]] = field(default_factory=dict)
    #: The blocks before those.
    before: dict[str, set[int]] = field(default_factory=dict)
    #: All blocks behind the first of a file that hold a quote: the second pass must cut files at the same places.
    seen: dict[str, set[int]] = field(default_factory=dict)


def look(spark: SparkSession, paths: list[str], separator: str, line_end: str, most: int) -> Blocks:
    """The first pass. `broken` is None for more than `most` files with line breaks.

    What the driver sees of the blocks is a number for each behind the first of a large file, and none of files of one
    block.
    """
    quoted = lines_of(spark, paths, line_end).filter(F.contains("value", F.lit('"')))
    states = with_states(quoted, separator).select("file", "block", "from_out", "from_in")
    blocks = materialized(states.mapInArrow(_maps, "file string, block bigint, from_out int, from_in int, opens bigint"))
    found = [r.file for r in blocks.filter("opens > 0").select("file").distinct().limit(most + 1).collect()]
    if not found:
        return Blocks([])
    in_order = W.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    fixed = F.col("from_out") == F.col("from_in")
    swaps = F.sum(F.when(~fixed & (F.col("from_out") == 1), 1).otherwise(0)).over(in_order.rowsBetween(W.unboundedPreceding, 0))
    ranked = blocks.withColumn("swaps", swaps)
    last = F.last(F.when(fixed, F.struct("from_out", "swaps")), ignorenulls=True).over(before)
    so_far = F.coalesce(F.lag("swaps").over(in_order), F.lit(0))
    ranked = ranked.withColumns({"last": last, "so_far": so_far})
    state = (F.coalesce(F.col("last.from_out"), F.lit(0)) + F.col("so_far") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2
    # The block after it begins as this one ends; blocks without a quote in between change nothing.
    end = F.when(state == 1, F.col("from_in")).otherwise(F.col("from_out"))
    ends = ranked.select("file", "block", end.alias("end")).filter("end = 1")
    open_at: dict[str, set[int]] = {}
    earlier: dict[str, set[int]] = {}
    if not ends.isEmpty():
        starts = lines_of(spark, paths, line_end).groupBy("file", "block").agg(F.lit(True).alias("start"))
        starts = starts.select("file", "block", F.lag("block").over(in_order).alias("previous"), F.lit(None).cast("int").alias("end"), "start")
        marks = starts.unionByName(ranked.select("file", "block", F.lit(None).cast("bigint").alias("previous"), end.alias("end"), F.lit(False).alias("start")))
        # A block's own row of states comes after its start.
        order = W.partitionBy("file").orderBy("block", F.desc("start")).rowsBetween(W.unboundedPreceding, -1)
        inside = marks.withColumn("inside", F.last("end", ignorenulls=True).over(order)).filter("start and inside = 1")
        for row in inside.select("file", "block", "previous").collect():
            open_at.setdefault(row.file, set()).add(row.block)
            earlier.setdefault(row.file, set()).add(row.previous)
    seen: dict[str, set[int]] = {}
    for row in blocks.filter("block > 0").select("file", "block").collect():
        seen.setdefault(row.file, set()).add(row.block)
    return Blocks(found if len(found) <= most else None, open_at, earlier, seen)


def _bytes(values: pa.Array) -> list[bytes]:
    return values.cast(pa.binary()).to_pylist()


class _Cutter:
    """Joins the lines of one block after the other to records."""

    def __init__(self, line_end: str, open_at: dict[str, set[int]], seen: dict[str, set[int]] | None) -> None:
        self.line_end, self.open_at, self.seen = line_end.encode(), open_at, seen
        self.key, self.size, self.state, self.held, self.kind = None, 0, 0, [], WHOLE

    def begin(self, key: tuple, size: int) -> None:
        self.key, self.size, self.held = key, size, []
        self.state = int(key[1] in self.open_at.get(key[0], ()))
        self.kind = THROUGH if self.state else HEADER if key[1] == 0 else WHOLE

    def rows(self, texts: pa.Array, kinds: list[int]) -> pa.RecordBatch:
        n = len(texts)
        columns = [pa.array([self.key[0]] * n, pa.string()), pa.array(np.full(n, self.key[1])), pa.array(np.full(n, self.size)), pa.array(kinds, pa.int32()), texts]
        return pa.RecordBatch.from_arrays(columns, names=["file", "block", "size", "kind", "text"])

    def flush(self, closed: bool) -> Iterator[pa.RecordBatch]:
        """The record that is open: it ends here, or goes on in the next block."""
        if self.held:
            kind = self.kind
            if closed:
                kind = ENDS if kind == THROUGH else kind
            else:
                kind = {WHOLE: BEGINS, HEADER: HEADER_BEGINS}.get(kind, kind)
            yield self.rows(pa.array([self.line_end.join(self.held).decode("utf-8", "replace")], pa.string()), [kind])
        self.held, self.kind = [], WHOLE

    def lines(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = rows.column("value")
        from_out, from_in = (rows.column(n).to_numpy().astype(np.int64) for n in ("from_out", "from_in"))
        if self.seen is not None and self.key[1] and self.key[1] not in self.seen.get(self.key[0], ()) and (from_out.any() or not from_in.all()):
            raise ValueError(f"{self.key[0]} is cut into other blocks than when it was looked at: scan it again")
        states, self.state = composed(from_out, from_in, self.state)
        starts = np.flatnonzero(states == 0)
        if not len(starts):
            self.held += _bytes(values)
            return
        first, last = int(starts[0]), int(starts[-1])
        self.held += _bytes(values.slice(0, first))
        if self.held:
            yield from self.flush(True)
        if self.kind == HEADER and first < last:  # the file's first record
            stop = int(starts[1])
            self.held = _bytes(values.slice(first, stop - first))
            yield from self.flush(True)
            first, starts = stop, starts[1:]
        if first < last:
            yield self.rows(self.joined(values, first, starts), [WHOLE] * (len(starts) - 1))
        self.held = _bytes(values.slice(last))

    def joined(self, values: pa.Array, first: int, starts: np.ndarray) -> pa.Array:
        """Records of the lines from `first` to the last start, a line end before each line that begins none."""
        last = int(starts[-1])
        offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset + first : values.offset + last + 1].astype(np.int64)
        buffer = values.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        goes_on = np.ones(last - first, bool)
        goes_on[starts[:-1] - first] = False
        if goes_on.any():
            width = len(self.line_end)
            data = np.insert(data, np.repeat(offsets[:-1][goes_on], width), np.tile(np.frombuffer(self.line_end, np.uint8), int(goes_on.sum())))
            offsets = offsets + width * np.concatenate([[0], np.cumsum(goes_on)])
        ends = offsets[starts - first].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


RECORD_SCHEMA = "file string, block bigint, size bigint, kind int, text string"


def records(lines: DataFrame, line_end: str, open_at: dict[str, set[int]], *, seen: dict[str, set[int]] | None = None,
            only: dict[str, set[int]] | None = None, crossing: bool = True) -> DataFrame:
    """file, block, size, kind, text: the second pass over `lines` with states.

    Blocks with quotes that are not `seen`, if that is given, fail the query. `only` names the blocks to look at, if not all. Without `crossing` a record that leaves its block fails the query.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(line_end, open_at, seen)
        for batch in batches:
            for key, rows in _blocks(batch):
                if only is not None and key[1] not in only.get(key[0], ()):
                    continue
                if key != cutter.key:
                    yield from finished(cutter)
                    cutter.begin(key, rows.column("size")[0].as_py())
                yield from cutter.lines(rows)
        yield from finished(cutter)

    def finished(cutter: _Cutter) -> Iterator[pa.RecordBatch]:
        if cutter.state and not crossing:
            raise ValueError(f"a quoted line break at the end of a block of {cutter.key[0]}: raise spark.sql.files.maxPartitionBytes or use multi_line")
        yield from cutter.flush(not cutter.state)

    return lines.select("file", "block", "size", "value", "from_out", "from_in").mapInArrow(cut, RECORD_SCHEMA)


def whole_records(spark: SparkSession, paths: list[str], separator: str, line_end: str, blocks: Blocks) -> DataFrame:
    """file, block, text: all records of files with line breaks but their headers; a blank line is none.

    A record that lies in several blocks counts to a block of its own behind the one in which it begins.
    """
    lines = lines_of(spark, paths, line_end)
    if blocks.broken is not None:
        # Not by the file alone: Spark would then list fewer files, and cut them into other blocks.
        lines = lines.filter(F.col("file").isin(blocks.broken) | F.col("value").isNull())
    lines = with_states(lines, separator)
    complete = records(lines, line_end, blocks.open_at, seen=blocks.seen).filter(F.col("kind") == WHOLE).select("file", "block", "text")
    if blocks.open_at:
        # The blocks on either side of an open border hold the parts.
        only = {f: starts | blocks.before[f] for f, starts in blocks.open_at.items()}
        complete = complete.unionByName(_put_together(records(lines, line_end, blocks.open_at, seen=blocks.seen, only=only), line_end))
    return complete.filter(F.col("text").rlike(r"[^\x00-\x20]"))


def _put_together(rows: DataFrame, line_end: str) -> DataFrame:
    """file, block, text of the records that lie in several blocks."""
    begins = F.col("kind").isin(BEGINS, HEADER_BEGINS)
    parts = materialized(rows.filter(begins | F.col("kind").isin(ENDS, THROUGH)).withColumn("begins", begins.cast("int")))
    # Within a block the end of one record comes before the beginning of the next.
    numbers = parts.select("file", "block", "begins").withColumn(
        "record", F.sum("begins").over(W.partitionBy("file").orderBy("block", "begins").rowsBetween(W.unboundedPreceding, 0)))
    together = parts.join(numbers, ["file", "block", "begins"]).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "begins", "size", "kind", "text"))).alias("parts"))
    first = F.col("parts")[0]
    text = F.array_join(F.transform("parts", lambda p: p["text"]), line_end)
    return together.filter(first["kind"] == BEGINS).select("file", (first["block"] + first["size"] - 1).alias("block"), text.alias("text"))
