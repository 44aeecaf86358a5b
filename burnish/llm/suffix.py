"""Repeated byte strings by a radix sort of suffixes that goes no deeper than the threshold.

Two suffixes are alike here if their first `length` bytes are equal, so the sort stops there, and its groups
are exactly the repeated strings. The passes, most significant digit first:

1. The digit is the suffix's anchor, the smallest hash of a gram of `gram` bytes within its first `length` bytes.
   Consecutive suffixes mostly share it, so that one row stands for a run of them (about 35 suffixes).
2. The digit is a hash of all bytes of the run. Equal runs hold equal suffixes; all but the earliest run are repeats.
   An anchor with a single run left has no other repeats, and its suffixes are not sorted any further.
3. The digit is a 128-bit hash of the first `length` bytes of each suffix that is still open.

A suffix that is not the earliest of its group marks its first `length` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, COUNTER_SCHEMA, added_up, byte_view, counted, counter_rows, forget, pieces, same, utf8, written
from .words import mixed

LENGTH = 100
GRAM = 32
#: Suffixes of one text that are taken at once, and bytes of texts whose runs are compared at once.
BLOCK = 1 << 19
SLICE_BYTES = 1 << 23
#: Runs of one anchor that meet in one task; of more frequent anchors every suffix is hashed and grouped by Spark.
GROUP_ROWS = 20_000
COUNTERS = 1 << 20
SPAN, OPEN, FREQUENT = 0, 1, 2

_RNG = np.random.default_rng(7)
_BYTES = _RNG.integers(1, 2**64, (2, 256), dtype=np.uint64, endpoint=False) | np.uint64(1)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


@lru_cache(maxsize=2)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    found = []
    for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        found.append(np.multiply.accumulate(steps))
    return found[0], found[1]


def _table(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over prefixes, from which any stretch's hash follows, and the inverse powers."""
    size = 1 << max(int(len(data) + 1).bit_length(), 16)
    power, inverse = _powers(which, size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def _hashed(table: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums, inverse = table
    return mixed((sums[stop] - sums[start]) * inverse[start])


def window_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of suffixes with one anchor, over stretches [begin, end) of the data; a stretch is at least `length` long.

    Of each run: the stretch, its first and last suffix, the anchor's hash and that of all its bytes.
    """
    first, second = _table(data, 0), _table(data, 1)
    sums, inverse = first
    grams = mixed((sums[gram:] - sums[: len(sums) - gram]) * inverse[: len(sums) - gram])
    low = np.uint64((1 << 20) - 1)
    key = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    width = length - gram + 1
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    anchor = (key & low).astype(np.int64)
    counts = ends - begins - length + 1
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    at = anchor[starts]
    stretch = np.repeat(np.arange(len(begins)), counts)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (stretch[1:] != stretch[:-1])]))
    last = np.append(new[1:], len(at)) - 1
    lo, hi = starts[new], starts[last]
    return {
        "stretch": stretch[new], "first": lo, "last": hi,
        "anchor": grams[at[new]].view(np.int64), "run": _hashed(second, lo, hi + length).view(np.int64),
    }


def _stretches(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about `BLOCK` suffixes, longer ones in parts: which text, begin and end of each part."""
    owner, begin, end, total = [], [], [], 0
    for i in np.flatnonzero(np.diff(offsets) >= length):
        for at in range(int(offsets[i]), int(offsets[i + 1]) - length + 1, BLOCK):
            stop = min(at + BLOCK + length - 1, int(offsets[i + 1]))
            if total and total + stop - at > BLOCK + length:
                yield np.array(owner), np.array(begin), np.array(end)
                owner, begin, end, total = [], [], [], 0
            owner.append(i)
            begin.append(at)
            end.append(stop)
            total += stop - at
    if owner:
        yield np.array(owner), np.array(begin), np.array(end)


def _runs_of(column: pa.Array, length: int, gram: int) -> dict[str, np.ndarray]:
    """All runs of all texts of a column: row, first and last suffix within the text, anchor, run."""
    data, offsets = byte_view(column)
    parts = []
    for owner, begin, end in _stretches(offsets, length):
        sizes = end - begin
        if len(begin) == 1:
            joined = data[begin[0] : end[0]]
        else:
            joined = np.concatenate([data[b:e] for b, e in zip(begin, end, strict=True)])
        at = np.cumsum(sizes) - sizes
        found = window_runs(joined, at, at + sizes, length, gram)
        row = owner[found.pop("stretch")]
        shift = (begin - at - offsets[owner])[np.searchsorted(at, found["first"], side="right") - 1]
        found["first"], found["last"], found["row"] = found["first"] + shift, found["last"] + shift, row
        parts.append(found)
    names = ("row", "first", "last", "anchor", "run")
    return {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in names}


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few megabytes of text."""
    for batch in batches:
        for start, end in pieces(byte_view(batch.column(text))[1], SLICE_BYTES, batch.num_rows):
            yield batch.slice(start, end - start)


def _frequent(docs: DataFrame, length: int, gram: int, group_rows: int) -> np.ndarray:
    """In how many parts the runs of an anchor are dealt out, by a hashed counter; 0 for all but frequent ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for batch in _slices(batches, 0):
            anchors = _runs_of(batch.column(0), length, gram)["anchor"]
            counters += np.bincount(anchors & (COUNTERS - 1), minlength=COUNTERS)
        if counters.any():
            yield counter_rows(counters, 256)

    counters = added_up(docs.select("text").mapInArrow(count, COUNTER_SCHEMA), 256, COUNTERS)
    above = counters - counters.mean()
    many = above > max(group_rows, 8 * counters.mean() ** 0.5)
    return np.where(many, np.ceil(above / group_rows), 0).astype(np.int32)


def _order(column: pa.Array, other: pa.Array) -> np.ndarray:
    """Rank of each row by (doc_id, twin), nulls last."""
    table = pa.table({"a": column, "b": other})
    by = pc.sort_indices(table, sort_keys=[("a", "ascending"), ("b", "ascending")], null_placement="at_end").to_numpy()
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return rank


def _first_passes(docs: DataFrame, length: int, gram: int, group_rows: int) -> DataFrame:
    """kind, doc_id, twin, start, stop, anchor: spans that are repeats, and runs that are still open."""
    parts_of = docs.sparkSession.sparkContext.broadcast(_frequent(docs, length, gram, group_rows))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = parts_of.value
        for batch in _slices(batches, 2):
            found = _runs_of(batch.column(2), length, gram)
            row, first, anchor, run = found["row"], found["first"], found["anchor"], found["run"]
            # Of equal runs in the batch, all but the earliest are known to be repeats.
            by = np.lexsort((first, _order(batch.column(0), batch.column(1))[row], run, anchor))
            row, first, last, anchor, run = row[by], first[by], found["last"][by], anchor[by], run[by]
            repeat = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (run[1:] == run[:-1])])[: len(row)]
            parts = dealt[anchor & (COUNTERS - 1)]
            part = np.where(parts > 0, (run & 0x7FFFFFFF) % np.maximum(parts, 1), -1)
            # A repeat is done with: it goes anywhere.
            anchor = np.where(repeat, (first + (row << 20)) * 0x9E3779B1, anchor)
            take = pa.array(row)
            out = [pa.array(np.where(repeat, SPAN, OPEN).astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take),
                   pa.array(first), pa.array(last + length), pa.array(anchor), pa.array(run), pa.array(part.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["kind", "doc_id", "twin", "start", "stop", "anchor", "run", "part"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            key = np.stack([batch.column(5).to_numpy(), batch.column(7).to_numpy()])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            cut = int(change[-1]) + 1 if len(change) else 0
            rest = batch.slice(cut)
            if cut:
                yield decided(batch.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield decided(rest)

    def decided(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind, anchor, run, part = (batch.column(i).to_numpy() for i in (0, 5, 6, 7))
        open_rows = np.flatnonzero(kind == OPEN)
        a, r, p = anchor[open_rows], run[open_rows], part[open_rows]
        new_group = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1])])[: len(a)]
        new_run = new_group | np.concatenate([[True], r[1:] != r[:-1]])[: len(a)]
        runs_in_group = np.add.reduceat(new_run.astype(np.int64), np.flatnonzero(new_group)) if len(a) else new_run.astype(np.int64)
        several = runs_in_group[np.cumsum(new_group) - 1] > 1
        kind = kind.copy()
        kind[open_rows] = np.where(~new_run, SPAN, np.where(p >= 0, FREQUENT, np.where(several, OPEN, -1)))
        keep = pa.array(kind >= 0)
        out = [pa.array(kind), *(batch.column(i) for i in range(1, 6))]
        return pa.RecordBatch.from_arrays(out, names=["kind", "doc_id", "twin", "start", "stop", "anchor"]).filter(keep)

    fields = f"kind int, doc_id {id_type}, twin bigint, start bigint, stop bigint, anchor bigint"
    rows = docs.select("doc_id", "twin", "text").mapInArrow(runs, f"{fields}, run bigint, part int").repartition("anchor", "part")
    ordered = rows.sortWithinPartitions("anchor", "part", "run", F.col("doc_id").asc_nulls_last(), "twin", "start")
    return ordered.mapInArrow(meet, fields)


def _windows(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every stretch of `length` bytes of each value: which value, where in it, and two hashes."""
    data, offsets = byte_view(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][owner] + place
    return owner, place, *(_hashed(_table(data, which), start, start + length).view(np.int64) for which in (0, 1))


def _marked(batch: pa.RecordBatch, owner: np.ndarray, place: np.ndarray, repeat: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of runs of repeats; the batch has doc_id, twin, start in columns 1 to 3."""
    here = np.flatnonzero(repeat)
    joined = (owner[here][1:] == owner[here][:-1]) & (place[here][1:] == place[here][:-1] + 1)
    begin = here[np.concatenate([[True], ~joined])[: len(here)]]
    end = here[np.concatenate([~joined, [True]])[: len(here)]]
    take = pa.array(owner[begin])
    base = batch.column(3).to_numpy()[owner[begin]]
    return pa.RecordBatch.from_arrays(
        [batch.column(1).take(take), batch.column(2).take(take), pa.array(base + place[begin]), pa.array(base + place[end] + length)],
        names=["doc_id", "twin", "start", "stop"])


def _last_pass(open_runs: DataFrame, length: int) -> DataFrame:
    """Spans (doc_id, twin, start, stop) of the repeats in open runs (kind, doc_id, twin, start, anchor, bytes)."""
    id_type = open_runs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, twin bigint, start bigint, stop bigint"

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            anchor = batch.column(4).to_numpy()
            change = np.flatnonzero(anchor[1:] != anchor[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            rest = batch.slice(cut)
            if cut:
                yield repeats(batch.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield repeats(rest)

    def repeats(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, place, a, b = _windows(batch.column(5), length)
        by = np.lexsort((b, a))  # stable: equal windows stay in the order of the rows
        repeat = np.zeros(len(by), bool)
        repeat[by[1:]] = (a[by[1:]] == a[by[:-1]]) & (b[by[1:]] == b[by[:-1]])
        return _marked(batch, owner, place, repeat, length)

    by_anchor = open_runs.filter(F.col("kind") == OPEN).repartition("anchor")
    ordered = by_anchor.sortWithinPartitions("anchor", F.col("doc_id").asc_nulls_last(), "twin", "start")
    spans = ordered.mapInArrow(sort, fields)
    frequent = open_runs.filter(F.col("kind") == FREQUENT)
    if frequent.isEmpty():
        return spans

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                owner, place, a, b = _windows(batch.column(5), length)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), batch.column(1).take(take), batch.column(2).take(take),
                     pa.array(batch.column(3).to_numpy()[owner] + place)], names=["a", "b", "doc_id", "twin", "start"])

    suffixes = written(frequent.mapInArrow(each, f"a bigint, b bigint, doc_id {id_type}, twin bigint, start bigint"), "suffixes")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "twin", "start")
    groups = suffixes.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = suffixes.join(groups, ["a", "b"]).filter(place != F.col("first"))
    return spans.unionByName(later.select("doc_id", "twin", "start", (F.col("start") + length).alias("stop")))


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS,
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Written spans (doc_id, twin, start, stop) in bytes, not yet merged, of `docs` (doc_id, twin, text)."""
    passed = written(_first_passes(docs, length, gram, group_rows), "passes")
    runs = F.collect_list(F.struct("start", "stop", "anchor", "kind")).alias("runs")
    wanted = written(passed.filter(F.col("kind") > SPAN).groupBy("doc_id", "twin").agg(runs), "open")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(2))
            runs = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            start, stop, anchor, kind = (runs.flatten().field(i) for i in range(4))
            begin, end = offsets[row] + start.to_numpy(), offsets[row] + stop.to_numpy()
            for at in range(0, len(row), 20_000):
                s = slice(at, at + 20_000)
                take = pa.array(row[s])
                cuts = [data[b:e].tobytes() for b, e in zip(begin[s], end[s], strict=True)]
                size = len(take)
                yield pa.RecordBatch.from_arrays(
                    [kind.slice(at, size), batch.column(0).take(take), batch.column(1).take(take), start.slice(at, size),
                     anchor.slice(at, size), pa.array(cuts, pa.binary())],
                    names=["kind", "doc_id", "twin", "start", "anchor", "bytes"])

    texts = _with_lists(docs, wanted, "runs", broadcast_rows)
    open_runs = written(texts.mapInArrow(cut, f"kind int, doc_id {id_type}, twin bigint, start bigint, anchor bigint, bytes binary"), "runs")
    spans = written(_last_pass(open_runs, length).unionByName(
        passed.filter(F.col("kind") == SPAN).select("doc_id", "twin", "start", "stop")), "spans")
    forget(passed, wanted, open_runs)
    return spans


def _with_lists(docs: DataFrame, lists: DataFrame, name: str, broadcast_rows: int) -> DataFrame:
    """doc_id, twin, text and the list, of documents that have one. Only their texts are moved."""
    ids = lists.select("doc_id", "twin")
    near = counted(ids, broadcast_rows)
    touched = docs.join(near, same(docs, near, ["doc_id", "twin"]), "left_semi")
    return touched.join(lists, same(touched, lists, ["doc_id", "twin"])).select(touched.doc_id, touched.twin, "text", name)


def _keyed(docs: DataFrame, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, twin, text: twin tells rows of one id apart by a hash of the text, and is 0 where the id is unique.

    Also the same without rows that repeat both.
    """
    plain = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    repeated = written(plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("other")), "ids")
    if repeated.isEmpty():
        plain = plain.withColumn("twin", F.lit(0).cast("bigint"))
        return plain, plain
    near = counted(repeated, broadcast_rows).withColumn("twice", F.lit(True))
    marked = plain.join(near, plain.doc_id.eqNullSafe(near.other), "left")
    keyed = marked.select("doc_id", "text", F.when(F.col("twice"), F.xxhash64("text")).otherwise(F.lit(0)).alias("twin"))
    once = keyed.filter("twin != 0").dropDuplicates(["doc_id", "twin"])
    return keyed, keyed.filter("twin = 0").unionByName(once)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS,
                   broadcast_rows: int = BROADCAST_ROWS, with_text: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if it is in a string of `length` bytes that also starts earlier: in a text with a smaller
    doc_id, or before in the same text. Strings are those of the input, overlaps count, and none goes across
    texts. A null text is empty; a null id comes after all others. Rows that repeat id and text are one document;
    rows that repeat only the id are ordered by a hash of the text. `with_text` adds kept_text, the bytes that are
    left (binary, as a cut may fall inside a character).
    """
    keyed, once = _keyed(docs, broadcast_rows)
    spans = repeated_spans(once, length=length, gram=gram, group_rows=group_rows, broadcast_rows=broadcast_rows)
    lists = written(spans.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "lists")
    forget(spans)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text binary" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(2))
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            start, stop = (lists.flatten().field(i).to_numpy() for i in range(2))
            base = int(ends[0])
            out = []
            for i in range(batch.num_rows):
                part = slice(int(ends[i]) - base, int(ends[i + 1]) - base)
                by = np.argsort(start[part], kind="stable")
                s, reach = start[part][by], np.maximum.accumulate(stop[part][by])
                new = np.concatenate([[True], s[1:] > reach[:-1]])
                begin, end = s[new], reach[np.concatenate([new[1:], [True]])]
                text = data[offsets[i] : offsets[i + 1]]
                left = np.ones(len(text), bool)
                for b, e in zip(begin, end, strict=True):
                    left[b:e] = False
                kept = text[left].tobytes()
                out.append((len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(columns[4], pa.binary()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    changed = _with_lists(keyed, lists, "spans", broadcast_rows).mapInArrow(cut, fields)
    near = counted(lists.select("doc_id", "twin"), broadcast_rows)
    zero = F.lit(0).cast("bigint")
    whole = keyed.join(near, same(keyed, near, ["doc_id", "twin"]), "left_anti").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").alias("kept_text")] if with_text else []))
    return whole.unionByName(changed)
