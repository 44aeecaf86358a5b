"""Sharding: the smallest capacity for which ordered groups of equal texts fit into contiguous shards.

Groups are ordered by a hash of their text. The driver never holds them: it holds the sizes of ranges of hashes,
and splits, one job a round, only ranges in which a cut may fall, until those are single groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, utf8, written

SHARDS = 16
#: Hexadecimal digits of the hash that tell ranges apart at first, and how many more a split adds.
FIRST_DIGITS, MORE_DIGITS = 3, 2


class Ranges:
    """Ranges of hashes in order: prefix, bytes, and whether one holds several groups."""

    def __init__(self, rows: list[tuple[str, int, bool]]):
        rows = sorted(rows)
        self.prefix = [r[0] for r in rows]
        self.size = np.array([r[1] for r in rows], np.int64)
        self.several = np.array([r[2] for r in rows], bool)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])

    def reach(self, at: int, capacity: int, divisible: bool) -> int:
        """How far one shard of the capacity goes from a place, in bytes. A larger group is a shard of its own."""
        goal = at + capacity
        if goal >= self.ends[-1]:
            return int(self.ends[-1])
        i = int(np.searchsorted(self.ends, goal, side="right")) - 1
        if divisible and self.several[i]:
            return goal
        if self.ends[i] > at:
            return int(self.ends[i])
        return at if self.several[i] else int(self.ends[i + 1])

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """The greedy check: where each shard ends if it takes all it can."""
        at, found = 0, []
        for _ in range(shards):
            at = self.reach(at, capacity, divisible)
            found.append(at)
        return found

    def smallest(self, shards: int, divisible: bool) -> int:
        """The smallest capacity with which everything fits, by binary search."""
        low, high = -1, int(self.ends[-1])
        while high - low > 1:
            middle = (low + high) // 2
            if self.cuts(middle, shards, divisible)[-1] == self.ends[-1]:
                high = middle
            else:
                low = middle
        return high

    def open_near(self, low: int, high: int) -> set[int]:
        """Ranges of several groups that a cut between the two places may fall into."""
        first = int(np.searchsorted(self.ends, low, side="right")) - 1
        last = int(np.searchsorted(self.ends, high, side="left"))
        return {i for i in range(max(first, 0), min(last, len(self.size))) if self.several[i]}

    def even(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """Ranges that begin shards 1.., each cut as near as it can be to an even share of what is left, so that no
        shard is above the capacity but for single groups; and the ranges to split to come nearer."""
        large = self.size > capacity
        back, at = [len(self.size)], len(self.size)
        for _ in range(shards - 1):  # the first range from which the rest fits into so many shards
            if at:
                at = min(int(np.searchsorted(self.ends, self.ends[at] - capacity, side="left")), at - 1)
            back.append(at)
        small = np.concatenate([[0], np.cumsum(np.where(large, 0, self.size))])
        above = np.concatenate([[0], np.cumsum(large)])
        begins, opened, at = [], set(), 0
        for k in range(1, shards):
            most = max(int(np.searchsorted(self.ends, self.ends[at] + capacity, side="right")) - 1, min(at + 1, len(self.size)))
            share = (small[-1] - small[at]) / max(shards - k + 1 - (above[-1] - above[at]), 1)
            near = int(np.searchsorted(small, small[at] + share, side="left"))
            if near and small[at] + share - small[near - 1] < small[near] - small[at] - share:
                near -= 1
            if back[shards - k] <= near <= most:
                goal = int(self.ends[at] + share)
                opened |= self.open_near(goal, goal + 1)
            at = max(min(max(near, back[shards - k]), most), at)
            begins.append(at)
        return begins, opened


def capacity_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """The hash prefix at which each shard but the first begins, and the capacity, of `groups` (hash, size)."""

    def ranges(part: DataFrame, digits: int) -> list[tuple[str, int, bool]]:
        by = part.groupBy(F.substring("hash", 1, digits).alias("prefix"))
        found = by.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("hash").alias("hash")).collect()
        return [(r.hash if r.n == 1 else r.prefix, r.size, r.n > 1) for r in found]

    state = Ranges(ranges(groups, FIRST_DIGITS))
    while True:
        low = state.smallest(shards, True)
        opened = {int(i) for i in np.flatnonzero(state.several & (state.size > low))}
        if not opened:
            high = state.smallest(shards, False)
            for a, b in zip(state.cuts(low, shards, False)[:-1], state.cuts(high, shards, True)[:-1], strict=True):
                opened |= state.open_near(a, b)
            if low == high or not opened:
                begins, opened = state.even(high, shards)
        if not opened:
            return [state.prefix[i] if i < len(state.prefix) else "g" for i in begins], high
        # All ranges of one length in one job; the shortest first.
        digits = min(len(state.prefix[i]) for i in opened)
        split = {state.prefix[i] for i in opened if len(state.prefix[i]) == digits}
        inside = groups.filter(F.substring("hash", 1, digits).isin(list(split)))
        stay = [(p, int(s), bool(m)) for p, s, m in zip(state.prefix, state.size, state.several, strict=True) if p not in split]
        state = Ranges(stay + ranges(inside, digits + MORE_DIGITS))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 1 (1 for a null text, whose checksum is that of an empty one). Rows of
    equal texts are one group and share a shard. The largest shard is as small as contiguous shards of ordered
    groups allow. So is the largest of the others, if a group larger than them has a shard of its own; within that
    capacity the cuts are made as even as they can be. Slots number a shard's rows from 0 by hash and doc_id, nulls first; rows that repeat
    both are numbered in any order. law is `bytes`, and grown_shard is null. An empty table gives no rows.
    """
    text = utf8(F.col("text"))
    plain = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                        F.md5(text).alias("hash"))
    # Ordered by hash and id: a large group's rows are spread over as many partitions as they fill.
    ordered = plain.repartitionByRange("hash", F.xxhash64("doc_id"), "doc_id").sortWithinPartitions("hash", F.xxhash64("doc_id"), "doc_id")
    rows = written(ordered.withColumn("place", F.monotonically_increasing_id()), "shard-rows")
    groups = written(rows.groupBy("hash").agg(F.sum("size").alias("size")), "shard-groups")
    begins, _ = capacity_cuts(groups, shards)
    forget(groups)
    number = sum((F.col("hash") >= F.lit(b)).cast("int") for b in begins) if begins else F.lit(0)
    # The high bits of a place are its partition, the low ones the row in it.
    in_shard = rows.withColumns({"shard": number, "partition": F.shiftright("place", 33)})
    parts = in_shard.groupBy("shard", "partition").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = W.partitionBy("shard").orderBy("partition").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("shard", "partition", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = in_shard.join(F.broadcast(starts), ["shard", "partition"])  # a row for each partition and shard in it
    slot = F.col("start") + F.col("place") - F.col("first")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                         slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
