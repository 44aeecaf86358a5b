"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, COUNTER_SCHEMA, added_up, byte_view, counted, counter_rows, pieces, utf8, written
from .words import runs, word_hashes

BUCKETS = 10_000
#: The bound of the sample of labelled rows.
LABELS = 200_000
PIECE_BYTES, PIECE_ROWS = 1 << 18, 1 << 12
#: Bins of a round of the search for the k-th largest key, and keys that are few enough to look at.
BINS, FEW = 4096, 10_000


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of words of the values, runs of marks included, and the value each is of."""
    words, counts = word_hashes(data, offsets, marks=True)
    one, owner = runs(words, counts, 1)
    enough = counts > 1  # a single word makes no pair
    two, pair_owner = runs(words[np.repeat(enough, counts)], counts[enough], 2)
    hashed = np.concatenate([one, two]) % np.uint64(buckets)
    return hashed.astype(np.int64), np.concatenate([owner, np.flatnonzero(enough)[pair_owner]])


def log_ratios(docs: DataFrame, target: str, buckets: int = BUCKETS) -> np.ndarray:
    """log p(bucket | rows where `target`) - log p(bucket | all rows), counted over all texts, each count plus one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((2, buckets), np.int64)
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = byte_view(batch.column(0))
            for start, end in pieces(offsets, PIECE_BYTES, PIECE_ROWS):
                hashed, owner = features(data, offsets[start : end + 1], buckets)
                counters[1] += np.bincount(hashed, minlength=buckets)
                counters[0] += np.bincount(hashed[wanted[start:end][owner]], minlength=buckets)
        if counters.any():
            yield counter_rows(counters, 2)

    partial = docs.select(utf8(F.col("text")).alias("text"), F.col(target)).mapInArrow(count, COUNTER_SCHEMA)
    wanted, raw = added_up(partial, 2, 2 * buckets).reshape(2, buckets) + 1.0
    return np.log(wanted / wanted.sum()) - np.log(raw / raw.sum())


def threshold(keys: DataFrame, k: int) -> float:
    """The k-th largest of the column `key`, exactly: each round counts bins and goes on in the one that holds it."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n == 0 or k <= 0:
        return float("inf")
    if k >= n:
        return low
    while True:
        inside = keys.filter(F.col("key").between(low, high))
        width = (high - low) / BINS
        if n <= FEW or width == 0 or low + width == low:
            for row in sorted(inside.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
                k -= row.n
                if k <= 0:
                    return row.key
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).alias("bin")
        bins = inside.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(bins.collect(), reverse=True):
            if k <= row.n:
                low, high, n = row.low, row.high, row.n
                break
            k -= row.n


def resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, buckets: int = BUCKETS, seed: int = 1,
             most_labels: int = LABELS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, log_weight, gumbel_key, kept.

    The target model is counted over documents that `labels` (doc_id, quality) has with quality 1, at most about
    `most_labels` of them by a hash of the id; the raw model over all documents. log_weight is the log of the
    ratio of a text's probabilities, summed over its words and pairs of words. To it comes Gumbel noise that the
    id alone decides, and the k largest keys are a sample without replacement by the weights. k is `share` of the
    texts that have words, by default the share of quality 1 among the labels. Texts without words, null or not,
    have no key and are not kept. Equal keys share their fate, so repeated rows do; a null id has noise of its own.
    Without labels of quality 1 both models are even and only the noise decides.
    """
    spark = docs.sparkSession
    counts = labels.filter("quality is not null").agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("quality") == 1).cast("bigint")), F.lit(0))).first()
    if share is None:
        share = counts[1] / counts[0] if counts[0] else 1.0
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good_id")).distinct()
    draw = F.xxhash64(F.lit(seed), F.lit("label"), "good_id").cast("double") / F.lit(2.0**64) + 0.5
    sample = written(good.filter(draw < most_labels / max(counts[1], 1)), "target")
    near = counted(sample, max(BROADCAST_ROWS, 2 * most_labels))
    marked = docs.select("doc_id", "text").join(near, F.col("doc_id") == F.col("good_id"), "left")
    ratios = log_ratios(marked.withColumn("wanted", F.col("good_id").isNotNull()), "wanted", buckets)
    if not counts[1]:
        ratios = np.zeros(buckets)
    sent = spark.sparkContext.broadcast(ratios)  # a fixed number of buckets
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            sums, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for start, end in pieces(offsets, PIECE_BYTES, PIECE_ROWS):
                hashed, owner = features(data, offsets[start : end + 1], buckets)
                sums[start:end] = np.bincount(owner, table[hashed], end - start)
                many[start:end] = (np.bincount(owner, minlength=end - start) + 1) // 2  # n words make n - 1 pairs
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), pa.array(sums)], names=["doc_id", "n_words", "log_weight"])

    weighted = docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(score, f"doc_id {id_type}, n_words bigint, log_weight double")
    even = (F.pmod(F.xxhash64(F.lit(seed), F.lit("gumbel"), "doc_id"), F.lit(2**53)).cast("double") + 0.5) / F.lit(2.0**53)
    key = F.when(F.col("n_words") > 0, F.col("log_weight") - F.log(-F.log(even)))
    rows = written(weighted.withColumn("gumbel_key", key), "weights")
    keys = rows.filter("gumbel_key is not null").select(F.col("gumbel_key").alias("key"))
    least = threshold(keys, round(share * keys.count()))
    return rows.withColumn("kept", F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False)))
