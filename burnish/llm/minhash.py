"""Near duplicates: consistent weighted samples of TF-IDF shingles in bands, verified by weighted Jaccard similarity.

A text is the set of its runs of five words (one run of all words if it has fewer), each weighing its number of
occurrences times 1 + log(N / df) / log(N), so that a run in all texts weighs 1 and one in a single text 2. The
document frequencies are counted over all texts in a table of a fixed number of hashed counters, from which the
mean load of a counter is taken off. All texts with the same weighted set are one node. Nodes that agree on all
samples of a band meet in a bucket; each is compared with the bucket's leader, and linked if similar enough.
Where a bucket then holds several classes, its members meet more leaders in two further turns, those with which they
share the most buckets. What is still open then is settled exactly: in each bucket that holds several classes, all
members meet those outside its largest class, in cells of a fixed size, so a group is never in one task. Within a cell
only texts are compared that share one of their rarest shingles, as any two similar enough do. So every two nodes
that share a bucket and are similar enough are in one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import (
    BROADCAST_ROWS,
    COUNTER_SCHEMA,
    added_up,
    byte_view,
    counted,
    counter_rows,
    forget,
    free_name,
    pieces,
    same,
    trimmed,
    utf8,
    written,
)
from .components import components
from .words import mixed, runs, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 10
BAND_ROWS = 4
#: Counters of document frequencies, and in how many rows a task hands them on.
COUNTERS = 1 << 20
BLOCKS = 1 << 8
#: Turns of comparisons with leaders; leaders of a bucket in a later turn, and how many of its buckets' a node then meets.
TURNS, ORDERS, CHOSEN = 3, 4, 16
#: Members that one task compares with a copy of a leader; members on each side of a cell, and their bytes on average.
MEMBERS = 256
CELL_BYTES = 1 << 23
#: Texts are taken in pieces of so many bytes and rows; a row number and 53 bits of a hash make one key.
PIECE_BYTES, PIECE_ROWS, HASH_BITS = 1 << 17, 1 << 11, 53


def weighted_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each value, sorted by value and hash: hash, number of occurrences, value."""
    hashes, owner = runs(*word_hashes(data, offsets), size)
    key = (owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes >> np.uint64(64 - HASH_BITS))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    return key & np.uint64((1 << HASH_BITS) - 1), times, (key >> np.uint64(HASH_BITS)).astype(np.int64)


# --- document frequencies


def idf_table(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Weight of a shingle's occurrence by its counter, from all texts; a fixed size whatever the table's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS + BLOCKS, np.int64)  # the last ones for the number of texts
        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            found = [np.zeros(0, np.int64)]
            for start, end in pieces(offsets, PIECE_BYTES, PIECE_ROWS):
                hashes, _, owner = weighted_sets(data, offsets[start : end + 1], size)
                found.append((hashes & np.uint64(COUNTERS - 1)).astype(np.int64))
                counters[-1] += len(np.unique(owner))
            counters[:COUNTERS] += np.bincount(np.concatenate(found), minlength=COUNTERS)
        if counters.any():
            yield counter_rows(counters, BLOCKS)

    partial = docs.select(utf8(F.col("text")).alias("text")).mapInArrow(trimmed(count), COUNTER_SCHEMA)
    counters = added_up(partial, BLOCKS, COUNTERS + BLOCKS).astype(np.float64)
    texts, counters = counters[-1], counters[:COUNTERS]
    if texts < 2:
        return np.ones(COUNTERS, np.float32)
    frequency = np.clip(counters - counters.sum() / COUNTERS, 1, texts)
    return (1 + np.log(texts / frequency) / np.log(texts)).astype(np.float32)


def weights(hashes: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return times.astype(np.float32) * idf[(hashes & np.uint64(COUNTERS - 1)).astype(np.intp)]


# --- consistent weighted sampling


def draws(samples: int, seed: int = 11) -> dict[str, np.ndarray]:
    """What sampling draws at random, by 16 bits of a hash each: r and log c of Gamma(2, 1)."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(1, 2**64, samples, dtype=np.uint64, endpoint=False) | np.uint64(1)
    add = rng.integers(1, 2**64, samples, dtype=np.uint64, endpoint=False)
    r, c = rng.standard_gamma(2.0, (2, 1 << 16))
    return {"odd": odd, "add": add, "r": r.astype(np.float32), "log_c": np.log(c).astype(np.float32)}


def consistent_samples(hashes: np.ndarray, weight: np.ndarray, starts: np.ndarray, random: dict) -> np.ndarray:
    """[sample, set]: 32 bits of the pair (k*, t*) that improved consistent weighted sampling selects.

    For each element k: r, c ~ Gamma(2, 1), beta ~ U(0, 1), fixed by the element and the sample;
    t = floor(log w / r + beta), log a = log c - r (t - beta + 1); the element with the smallest a is selected.
    """
    log_w = np.log(weight)
    name = hashes * np.uint64(0xD6E8FEB86659FD93)
    name = (name >> np.uint64(32)).astype(np.int64)
    out = np.empty((len(random["odd"]), len(starts)), np.uint64)
    low = np.uint64(0xFFFF)
    x, packed = np.empty_like(hashes), np.empty_like(hashes)
    for j, (odd, add) in enumerate(zip(random["odd"], random["add"], strict=True)):
        np.add(hashes, add, out=x)
        x *= odd
        np.right_shift(x, np.uint64(29), out=packed)
        x ^= packed
        x *= np.uint64(0x94D049BB133111EB)
        x >>= np.uint64(16)
        r = random["r"].take((x & low).view(np.int64), mode="clip")
        x >>= np.uint64(16)
        beta = (x & low).astype(np.float32)
        beta *= np.float32(2**-16)
        x >>= np.uint64(16)
        log_a = random["log_c"].take(x.view(np.int64), mode="clip")
        t = log_w / r
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= 1
        beta *= r
        log_a += beta
        log_a += 40  # positive, so that its bits order as it does
        np.left_shift(log_a.view(np.uint32).astype(np.uint64), np.uint64(32), out=packed)
        chosen = t.astype(np.int64)
        chosen *= 0x9E3779B1
        chosen ^= name
        chosen &= 0xFFFFFFFF
        packed |= chosen.view(np.uint64)
        out[j] = np.minimum.reduceat(packed, starts)
    out &= np.uint64(0xFFFFFFFF)
    return out


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """[set, band]: a hash of the band's number and samples."""
    rows = len(samples) // bands
    keys = np.empty((samples.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.full(samples.shape[1], b + 1, np.uint64)
        for sample in samples[b * rows : (b + 1) * rows]:
            key *= np.uint64(0x9E3779B97F4A7C15)
            key = mixed(key + sample)
        keys[:, b] = key
    return keys


def set_names(hashes: np.ndarray, times: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128 bits that name each weighted set."""
    halves = []
    for factor in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        part = hashes * np.uint64(factor)
        part += times.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        halves.append(np.add.reduceat(mixed(part), starts))
    both = np.ascontiguousarray(np.stack(halves, axis=1)).view(np.uint8).reshape(len(starts), 16)
    return [row.tobytes() for row in both]


def signatures(docs: DataFrame, idf: np.ndarray, *, size: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, content (a hash of the text), node (null without a word) and a key for each band."""
    sent = docs.sparkSession.sparkContext.broadcast((idf, draws(bands * band_rows)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, random = sent.value
        for batch in batches:
            data, offsets = byte_view(batch.column(2))
            nodes, keys = np.full(batch.num_rows, None, object), np.zeros((batch.num_rows, bands), np.uint64)
            for start, end in pieces(offsets, PIECE_BYTES, PIECE_ROWS):
                hashes, times, owner = weighted_sets(data, offsets[start : end + 1], size)
                if len(hashes):
                    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    rows = owner[starts] + start
                    nodes[rows] = set_names(hashes, times, starts)
                    keys[rows] = band_keys(consistent_samples(hashes, weights(hashes, times, table), starts, random), bands)
            ends = np.arange(0, keys.size + 1, bands, dtype=np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), values],
                                             names=["doc_id", "content", "node", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("content"), utf8(F.col("text")).alias("text"))
    return texts.mapInArrow(trimmed(sign), f"doc_id {kind}, content bigint, node binary, keys array<bigint>")


# --- verification


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, size: int) -> DataFrame:
    """node, leader, similarity of each of the pairs (node, leader), whose texts are in `texts` (node, text).

    A leader's text goes to as many tasks as its members fill, `MEMBERS` each.
    """
    sent = texts.sparkSession.sparkContext.broadcast(idf)
    many = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    dealt = pairs.join(many, "leader").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts")
    members = dealt.join(texts, "node").select("leader", "part", F.lit(1).alias("role"), "node", "text")
    heads = dealt.select("leader", "part").distinct().join(texts.withColumnRenamed("node", "leader"), "leader")
    rows = members.unionByName(heads.select("leader", "part", F.lit(0).alias("role"), F.col("leader").alias("node"), "text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, leader, theirs = sent.value, None, None
        for batch in batches:
            leaders, roles, nodes = (batch.column(i).to_pylist() for i in (0, 2, 3))
            data, offsets = byte_view(batch.column(4))
            out = ([], [], [])
            for start, end in pieces(offsets, PIECE_BYTES, PIECE_ROWS):
                hashes, times, owner = weighted_sets(data, offsets[start : end + 1], size)
                weight = weights(hashes, times, table).astype(np.float64)
                edges = np.searchsorted(owner, np.arange(end - start + 1))
                for i in range(start, end):
                    part = slice(edges[i - start], edges[i - start + 1])
                    own = (hashes[part], weight[part], weight[part].sum())
                    if roles[i] == 0:
                        leader, theirs = leaders[i], own
                        continue
                    if leader != leaders[i]:
                        raise ValueError("a member came without its leader")
                    at = np.minimum(np.searchsorted(theirs[0], own[0]), len(theirs[0]) - 1)
                    common = np.minimum(own[1], theirs[1][at])[theirs[0][at] == own[0]].sum()
                    for column, value in zip(out, (nodes[i], leader, common / (own[2] + theirs[2] - common)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.float64())],
                                             names=["node", "leader", "similarity"])

    dealt_rows = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "role")
    return dealt_rows.mapInArrow(trimmed(compare), "node binary, leader binary, similarity double")


def links(docs: DataFrame, signed: DataFrame, idf: np.ndarray, *, similarity: float = SIMILARITY, size: int = SHINGLE,
          broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Verified links between nodes (node, leader, similarity), and the label of each linked node."""
    nodes = written(signed.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "content")).alias("at"), F.first("keys").alias("keys")), "nodes")
    bands = nodes.select("node", F.explode("keys").alias("key"))
    full = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = written(bands.join(full, "key"), "met")
    # The whole text of each node that meets another, from one of its rows.
    wanted = written(nodes.join(met.select("node").distinct(), "node").select("node", "at.*"), "wanted")
    source = docs.select("doc_id", utf8(F.col("text")).alias("text"), F.xxhash64("text").alias("content"))
    near = counted(wanted, broadcast_rows)
    texts = written(source.join(near, same(source, near, ["doc_id", "content"])).select("node", "text"), "texts")
    forget(wanted)
    found, tried, labels = [], [], None
    for turn in range(TURNS):
        tried.append(written(_leaders(met, labels, turn, tried), "pairs"))
        linked = written(_verified(tried[-1], texts, idf, size).filter(F.col("similarity") >= similarity).distinct(), "links")
        found.append(linked)
        if turn == 0:
            labels = components(linked.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    labels, before = _relabelled(reduce(DataFrame.unionByName, found[1:]), labels), labels
    found.append(written(_settled(met, labels, nodes, texts, idf, similarity, size), "links"))
    labels, then = _relabelled(found[-1], labels), labels
    forget(met, nodes, texts, before, then, *tried)
    return reduce(DataFrame.unionByName, found), labels


def _leaders(met: DataFrame, labels: DataFrame | None, turn: int, tried: list[DataFrame]) -> DataFrame:
    """Pairs (node, leader) of nodes with different labels that share a bucket (key, node), none of which was tried.

    In the first turn each bucket has one leader. Later, `ORDERS` leaders are drawn in buckets that hold several labels
    after the first, and a node meets the `CHOSEN` ones with which it shares the most buckets: as many pairs as there are
    nodes, times a fixed number, however large a bucket is.
    """
    if labels is None:
        rows, orders = met.select("key", "node", F.col("node").alias("label")), 1
    else:
        rows, orders = met.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), ORDERS
    drawn = [F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn * ORDERS + k))) for k in range(orders)]
    heads = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.array(*drawn).alias("heads"))
    heads = heads.filter("low != high").select("key", F.explode(F.array_distinct("heads")).alias("head"))
    heads = heads.select("key", F.col("head.node").alias("leader"), F.col("head.label").alias("leader_label"))
    pairs = rows.join(heads, "key").filter("label != leader_label").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("shared"))
    for before in tried:
        pairs = pairs.join(before, ["node", "leader"], "left_anti")
    if labels is not None:
        best = W.partitionBy("node").orderBy(F.desc("shared"), F.xxhash64("leader", F.lit(turn)))
        pairs = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= CHOSEN)
    return pairs.select("node", "leader")


def _cells(met: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Where the members of buckets that hold several labels meet: key, i, j, role, node, label, minor.

    Those outside the bucket's most frequent label (minor) are dealt to rows i of a grid of cells, in role 0, and all
    members to its columns j, in role 1; each is in all cells of its row or column. Two of different labels meet, as one
    of them is minor.
    """
    rows = met.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sized = rows.join(texts.select("node", F.octet_length("text").cast("bigint").alias("bytes")), "node")
    groups = sized.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    most = F.max(F.struct("n", "label", "bytes"))
    buckets = groups.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), most.alias("top"))

    def sides(n, size):
        return F.greatest(F.ceil(n / MEMBERS), F.ceil(size / CELL_BYTES)).cast("int")

    n, size = F.col("n"), F.col("bytes")
    buckets = buckets.filter("labels > 1").select("key", F.col("top.label").alias("top"), sides(n, size).alias("wide"),
                                                  sides(n - F.col("top.n"), size - F.col("top.bytes")).alias("high"))
    placed = rows.join(buckets, "key").withColumn("minor", F.col("label") != F.col("top"))
    i, j = F.pmod(F.xxhash64("node"), "high").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "wide").cast("int")
    every, what = F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), ("node", "label", "minor")
    minor = placed.filter("minor").select("key", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"), F.lit(0).alias("role"), *what)
    return minor.unionByName(placed.select("key", every, j.alias("j"), F.lit(1).alias("role"), *what))


def rarest(hashes: np.ndarray, weight: np.ndarray, idf: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, so many that the others weigh less than `similarity` of it.

    Two sets that are similar enough share one of these: in the order from rare to frequent, one set's rarest end
    first, and if it shared none of them with the other's, what they share would weigh too little.
    """
    order = np.lexsort((hashes, -idf[(hashes & np.uint64(COUNTERS - 1)).astype(np.intp)]))
    so_far = np.cumsum(weight[order])
    return hashes[order[: np.searchsorted(so_far, so_far[-1] * (1 - similarity * (1 - 1e-9)), side="right") + 1]]


class Minor:
    """The sets on one side of a cell, to be compared with others one by one."""

    def __init__(self, key: int, idf: np.ndarray, similarity: float) -> None:
        self.key, self.idf, self.similarity = key, idf, similarity
        self.nodes, self.labels, self.keys, self.hashes, self.weight = [], [], [], [], []
        self.above: dict[bytes, bytes] = {}
        self.built = False

    def add(self, node: bytes, label: bytes, keys: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> None:
        for column, value in zip((self.nodes, self.labels, self.keys, self.hashes, self.weight), (node, label, keys, hashes, weight), strict=True):
            column.append(value)

    def build(self) -> None:
        self.known, ids = np.unique(np.concatenate(self.hashes), return_inverse=True)
        self.ids = np.split(ids, np.cumsum([len(h) for h in self.hashes])[:-1])
        self.other = np.zeros(len(self.known))
        self.total, self.bands = np.array([w.sum() for w in self.weight]), np.stack(self.keys)
        rare = [rarest(h, w, self.idf, self.similarity) for h, w in zip(self.hashes, self.weight, strict=True)]
        owner, rare = np.repeat(np.arange(len(rare)), [len(r) for r in rare]), np.concatenate(rare)
        order = np.argsort(rare, kind="stable")
        self.rare, self.owner, self.built = rare[order], owner[order], True

    def top(self, label: bytes) -> bytes:
        while (above := self.above.get(label, label)) != label:
            label = above
        return label

    def links(self, node: bytes, label: bytes, minor: bool, keys: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> Iterator[tuple]:
        """node, other node, similarity: links to sets of other labels, but for labels that links of the cell connect."""
        if not self.built:
            self.build()
        rare = rarest(hashes, weight, self.idf, self.similarity)
        ranges = zip(np.searchsorted(self.rare, rare), np.searchsorted(self.rare, rare, side="right"), strict=True)
        found = np.unique(np.concatenate([self.owner[a:b] for a, b in ranges]))
        total, theirs = weight.sum(), self.total[found]
        found = found[np.minimum(total, theirs) >= np.maximum(total, theirs) * self.similarity * (1 - 1e-9)]
        # Two that share several buckets are compared in the first of them.
        band = int(np.flatnonzero(keys == self.key)[0])
        found = found[~(self.bands[found, :band] == keys[:band]).any(axis=1)]
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        here = self.known[at] == hashes
        self.other[at[here]] = weight[here]
        for k in found.tolist():
            if (minor and self.nodes[k] <= node) or (one := self.top(self.labels[k])) == (two := self.top(label)):
                continue
            common = np.minimum(self.weight[k], self.other[self.ids[k]]).sum()
            if (alike := common / (self.total[k] + total - common)) >= self.similarity:
                self.above[max(one, two)] = min(one, two)
                yield node, self.nodes[k], alike
        self.other[at[here]] = 0


def _settled(met: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float, size: int) -> DataFrame:
    """node, leader, similarity: links that join all nodes of different labels that share a bucket and are similar enough."""
    sent = texts.sparkSession.sparkContext.broadcast(idf)
    cells = written(_cells(met, labels, texts), "cells")
    open_nodes = cells.select("node").distinct()
    read = texts.join(open_nodes, "node", "left_semi").join(nodes.select("node", "keys"), "node")
    rows = cells.join(read, "node").select("key", "i", "j", "role", "node", "label", "minor", "keys", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cell, others = sent.value, None, None
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            roles, names, of, minor = (batch.column(i).to_pylist() for i in range(3, 7))
            bands = np.asarray(batch.column(7).flatten()).reshape(batch.num_rows, -1)
            data, offsets = byte_view(batch.column(8))
            out = []
            for start, end in pieces(offsets, PIECE_BYTES, PIECE_ROWS):
                hashes, times, owner = weighted_sets(data, offsets[start : end + 1], size)
                weight = weights(hashes, times, table).astype(np.float64)
                edges = np.searchsorted(owner, np.arange(end - start + 1))
                for i in range(start, end):
                    part = slice(edges[i - start], edges[i - start + 1])
                    if places[i] != cell:
                        cell, others = places[i], Minor(places[i][0], table, similarity)
                    if roles[i] == 0:
                        others.add(names[i], of[i], bands[i], hashes[part], weight[part])
                    else:
                        out += others.links(names[i], of[i], minor[i], bands[i], hashes[part], weight[part])
            columns = zip(*out, strict=True) if out else [()] * 3
            kinds = [pa.binary(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "leader", "similarity"])

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
    return dealt.mapInArrow(trimmed(compare), "node binary, leader binary, similarity double")


def _relabelled(linked: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels after more links: components of labels, in place of components of nodes."""
    ends = linked.select(F.col("node").alias("a"), F.col("leader").alias("b"))
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        ends = ends.join(of, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    ends = written(ends, "ends")
    merged = components(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    new = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(new.select("node", F.col("node").alias("label")))
    moved = every.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    after = written(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
    forget(ends, merged)
    return after


def classes(docs: DataFrame, *, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS,
            band_rows: int = BAND_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, content, class_id, class_size, kept.

    A class holds all rows that links of at least `similarity` connect; its id is the smallest doc_id in it, and
    the row with that id is kept. Equal sets of shingles have similarity 1. A text that is null or has no word is
    alone in its class. Rows that repeat an id are one document: all of them are kept or none. A null id is kept
    if no other row of its class has an id. `content` is a hash of the text, to tell rows of one id apart.
    """
    idf = idf_table(docs, size)
    signed = written(signatures(docs, idf, size=size, bands=bands, band_rows=band_rows), "signatures")
    _, labels = links(docs, signed, idf, similarity=similarity, size=size, broadcast_rows=broadcast_rows)
    rows = signed.select("doc_id", "content", "node")
    rows = rows.join(labels, "node", "left").select("doc_id", "content", F.coalesce("label", "node").alias("label"))
    worded = rows.filter("label is not null")
    total = worded.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    grouped = worded.join(total, "label").select("doc_id", "content", "class_id", "class_size")
    alone = rows.filter("label is null").select("doc_id", "content", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """The rows of `docs` that `classes` keeps, with their columns as they are."""
    key, content = free_name(docs.columns, "key_id"), free_name(docs.columns, "key_content")
    marked = classes(docs, broadcast_rows=broadcast_rows, **how)
    gone = written(marked.filter("not kept").select(F.col("doc_id").alias(key), F.col("content").alias(content)).distinct(), "near-gone")
    keyed = docs.withColumns({key: F.col("doc_id"), content: F.xxhash64("text")})
    gone = counted(gone, broadcast_rows)
    return keyed.join(gone, same(keyed, gone, [key, content]), "left_anti").drop(key, content)
