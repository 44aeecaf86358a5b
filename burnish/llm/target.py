"""Documents drawn towards a target: weights from an array of gains by hashed words, Gumbel noise, and an exact top share.

The cutoff is found by weighted selection: each block of remaining keys gives its median, the median of these by the
sizes of their blocks is the next pivot, and the side of it that cannot hold the cutoff, a quarter of the keys at
least, is left out. The winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COUNTER_SCHEMA, added_up, byte_view, counter_rows, numbered, pieces, utf8, written
from .words import FOLDED, IN_WORDS

PIECE_BYTES, PIECE_ROWS = 1 << 20, 1 << 14
#: Bytes of a text that are taken at once.
BLOCK = 1 << 20
#: Bytes of a word from which on it is hashed on its own.
LONG_WORD = 256
#: Remaining keys that give one median, and few enough to be sorted at once.
MEDIAN_ROWS, FEW = 1 << 20, 4096

#: The table of CRC-32, by its rule.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_START = np.uint32(0xFFFFFFFF)


def _after(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of words, all words a byte at a time; long words one by one."""
    order = np.argsort(-sizes, kind="stable")
    state, starts, sizes = state[order], starts[order], sizes[order]
    long = int(np.searchsorted(-sizes, -LONG_WORD, side="left"))
    for i in range(long):
        word = data[starts[i] : starts[i] + sizes[i]]
        state[i] = zlib.crc32(word, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    left = np.searchsorted(-sizes, -np.arange(LONG_WORD), side="left")  # words that have a byte there
    for k in range(LONG_WORD):
        if left[k] <= long:
            break
        now = state[long : left[k]]
        state[long : left[k]] = _CRC[(now ^ data[starts[long : left[k]] + k]) & 255] ^ (now >> 8)
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int, max_run: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of all runs of 1 to `max_run` words of the values, a block at a time: (buckets, value of each, value of each word)."""
    at, end = int(offsets[0]), int(offsets[-1])
    tail: list[tuple[int, np.uint32]] = []  # runs that end with the last word so far: their value and state
    while at < end:
        stop = min(at + BLOCK, end)
        if stop < end:  # end between words, or else with the word
            gaps = np.flatnonzero(IN_WORDS[data[at:stop]] == 0)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                while stop < end and IN_WORDS[data[stop]]:
                    stop += 1
        folded = FOLDED[data[at:stop]]
        inside = folded != 0
        before = np.empty(len(inside), bool)
        before[:1], before[1:] = False, inside[:-1]
        before[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at] = False  # words end with their text
        first = np.flatnonzero(inside & ~before)
        if len(first):
            sizes = np.add.reduceat(inside, first, dtype=np.int64)
            owner = np.searchsorted(offsets, first + at, side="right") - 1
            state = _after(np.full(len(first), _START), folded, first, sizes)
            every, owners, last = [state], [owner], [(int(owner[-1]), state[-1])]
            for n in range(2, max_run + 1):
                # A run of n words goes on from the run of n - 1 words that ends one word earlier.
                earlier = np.concatenate([np.array([tail[n - 2][1] if len(tail) > n - 2 else 0], np.uint32), state[:-1]])
                of = np.concatenate([[tail[n - 2][0] if len(tail) > n - 2 else -1], owner[:-1]])
                valid = of == owner
                if n > 2:
                    valid[1:] &= ended[:-1]  # noqa: F821
                spaced = _CRC[(earlier ^ np.uint32(32)) & 255] ^ (earlier >> 8)
                state = _after(spaced, folded, first, sizes)
                every.append(state[valid])
                owners.append(owner[valid])
                ended = valid
                last.append((int(owner[-1]) if valid[-1] else -1, state[-1]))
            tail = last
            yield (np.concatenate(every) ^ _START).astype(np.int64) % buckets, np.concatenate(owners), owner
        at = stop


def bucket_counts(texts: DataFrame, buckets: int, max_run: int) -> list[int]:
    """How many features of all values of the first column fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            for start, end in pieces(offsets, PIECE_BYTES, PIECE_ROWS):
                for hashed, _, _ in features(data, offsets[start : end + 1], buckets, max_run):
                    counters += np.bincount(hashed, minlength=buckets)
        if counters.any():
            yield counter_rows(counters, 1)

    return added_up(texts.mapInArrow(count, COUNTER_SCHEMA), 1, buckets).tolist()


def gains(raw: list[int], target: list[int]) -> np.ndarray:
    """Each bucket's floor(1000 ln((t + 1)(S + n) / ((s + 1)(T + n)))) for n buckets."""
    n = len(raw)
    all_raw, all_target = float(sum(raw) + n), float(sum(target) + n)
    found = [math.floor(1000 * math.log(float(t + 1) * all_raw / (float(s + 1) * all_target))) for s, t in zip(raw, target, strict=True)]
    return np.array(found, np.int64)


def _block_medians(keys: DataFrame, pivot: int | None) -> list:
    """For each block of keys: how many are above the pivot, equal and below, and the medians of both sides."""

    def split(held: np.ndarray) -> tuple:
        if pivot is None:
            return (0, 0, len(held), None, int(np.partition(held, len(held) // 2)[len(held) // 2]))
        above, below = held[held > pivot], held[held < pivot]
        mid = [int(np.partition(x, len(x) // 2)[len(x) // 2]) if len(x) else None for x in (above, below)]
        return (len(above), len(held) - len(above) - len(below), len(below), *mid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, rows = [], 0, []
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            many += len(held[-1])
            if many >= MEDIAN_ROWS:
                rows.append(split(np.concatenate(held)))
                held, many = [], 0
        if many:
            rows.append(split(np.concatenate(held)))
        if rows:
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["above", "equal", "below", "high", "low"])

    return keys.mapInArrow(run, "above bigint, equal bigint, below bigint, high bigint, low bigint").collect()


def _weighted_median(values: list[tuple[int, int]]) -> int:
    """The value with half of the weight on either side; of (value, weight)."""
    half, passed = sum(n for _, n in values) / 2, 0
    for value, n in sorted(values):
        passed += n
        if passed >= half:
            return value
    raise ValueError("no values")


def cutoff(keys: DataFrame, k: int, few: int = FEW) -> tuple[int, int]:
    """The k-th largest of a column `key` without nulls, and how many equal ones are among the k largest.

    A round reads the keys that remain, and the driver sees a row for every `MEDIAN_ROWS` of them and for every task.
    """
    blocks = _block_medians(keys, None)
    low, high, left = None, None, sum(b.below for b in blocks)
    if not 1 <= k <= left:
        raise ValueError(f"no {k}-th of {left} keys")
    pivot = _weighted_median([(b.low, b.below) for b in blocks])
    remaining = keys
    while left > few:
        blocks = _block_medians(remaining, pivot)
        above, equal = sum(b.above for b in blocks), sum(b.equal for b in blocks)
        if k <= above:
            low, left = pivot, above
            pivot = _weighted_median([(b.high, b.above) for b in blocks if b.above])
        elif k <= above + equal:
            return pivot, k - above
        else:
            k, high, left = k - above - equal, pivot, left - above - equal
            pivot = _weighted_median([(b.low, b.below) for b in blocks if b.below])
        remaining = keys
        if low is not None:
            remaining = remaining.filter(F.col("key") > low)
        if high is not None:
            remaining = remaining.filter(F.col("key") < high)
    ordered = sorted((r.key for r in remaining.collect()), reverse=True)
    return ordered[k - 1], k - sum(x > ordered[k - 1] for x in ordered)


def resample(docs: DataFrame, benchmark: DataFrame, *, percent: int = 10, min_words: int = 20, max_run: int = 1,
             buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_features, weight, score, rank.

    Words are runs of letters, digits and bytes from 0x80, A-Z as a-z; features all runs of 1 to `max_run` of them,
    joined by a space, in buckets by their CRC-32. A bucket's gain compares its share of `benchmark` texts with that
    of all `docs`; weight is the sum over a text, score adds Gumbel noise that `seed` and the id decide. Of the N rows
    with at least `min_words` words the floor(`percent` N / 100) highest scores are drawn and ranked, equal ones by
    the smaller id, then by fewer features; rank is null for the others.

    A null text has no words, weight 0 and noise of its own. A null id counts as an empty one in the noise and comes
    first among equals. Repeated rows are rows of their own: each is counted, scored alike and ranked one after the
    other. Without any benchmark words the gains follow from its empty counts. Ids are whole numbers; other columns do
    not matter.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"))
    table = gains(bucket_counts(texts.select("text"), buckets, max_run), bucket_counts(benchmark.select(utf8(F.col("text"))), buckets, max_run))
    sent = docs.sparkSession.sparkContext.broadcast(table)  # a fixed number of buckets

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            words, many, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for start, end in pieces(offsets, PIECE_BYTES, PIECE_ROWS):
                for hashed, owner, word_owner in features(data, offsets[start : end + 1], buckets, max_run):
                    words[start:end] += np.bincount(word_owner, minlength=end - start)
                    many[start:end] += np.bincount(owner, minlength=end - start)
                    np.add.at(sums, start + owner, table[hashed])
            columns = [batch.column(0), pa.array(words), pa.array(many), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    weighted = texts.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = written(weighted.withColumn("score", F.col("weight") + noise), "target-scores")

    able = F.col("n_words") >= min_words
    k = rows.filter(able).count() * percent // 100
    none = rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    if k < 1:
        return none
    scores = rows.filter(able).select(F.col("score").alias("key"))
    least, ties = cutoff(scores, k)
    # Of two equal scores the smaller id is drawn: the larger of the inverted ids.
    inverted = F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1))
    last, _ = cutoff(rows.filter(able & (F.col("score") == least)).select(inverted.alias("key")), ties)
    drawn = able & ((F.col("score") > least) | ((F.col("score") == least) & (inverted >= last)))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("n_features")]
    winners = numbered(rows.filter(drawn).drop("n_words"), "target-winners", "rank", order)
    # Rows that are equal in all of this may be one too many.
    ranked = winners.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    losers = rows.filter(~drawn).select(*none.columns[:-1], F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*none.columns).unionByName(losers)
