"""Token counts from a cache: only texts that no earlier run has counted are encoded, each once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import BROADCAST_ROWS, byte_view, counted, pieces, utf8, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"
LONG_TOKENS = 4096
#: Bytes of text whose tokens are in memory at once; a longer text is on its own.
ENCODE_BYTES = 1 << 20


def counter(path: str, model: bytes):
    """A function from texts to numbers of tokens, as the library of the file's kind counts them."""
    if path.endswith(".model"):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    if path.endswith(".json"):
        tokenizer = Tokenizer.from_str(model.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"no library for {path}")


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of one tokenizer; a digest that two runs have appended counts once."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:  # no run has written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, limit: int = LONG_TOKENS,
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    `cache_path` is a folder that all executors share; it need not exist. Its rows are keyed by the SHA-256 of the
    tokenizer's file and of the text's bytes (a null text is empty; no other normalisation, as every change of a
    text may change its tokens). Texts whose digest is missing are encoded once each, whole, and appended; a run
    that fails before that appends nothing, and one that is repeated finds what the first has appended. Which of
    several equal texts is read does not matter. The model travels in the job, so executors need no such file.
    """
    spark = docs.sparkSession
    model = Path(tokenizer_path).read_bytes()
    version = hashlib.sha256(model).hexdigest()
    text = F.coalesce("text", F.lit(""))
    digested = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(utf8(F.col("text")), 256)).alias("digest"))
    rows = written(digested.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest"), "count-rows")
    # One row of each text, by its id; copies is how many rows have both.
    ids = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    texts = written(ids.groupBy("digest").agg(F.min(F.struct("doc_id", "copies")).alias("one")).select("digest", "one.*"), "count-texts")
    missing = written(texts.join(read_cache(spark, cache_path, version), "digest", "left_anti"), "count-missing")

    def texts_of(wanted: DataFrame) -> DataFrame:
        chosen = counted(wanted, broadcast_rows)
        found = digested.join(chosen, (digested.digest == chosen.digest) & digested.doc_id.eqNullSafe(chosen.doc_id), "left_semi")
        return found.select("digest", "text")

    misses = texts_of(missing.filter("copies = 1"))
    repeated = missing.filter("copies > 1")
    if not repeated.isEmpty():  # rows that repeat text and id: one of them is encoded
        misses = misses.unionByName(texts_of(repeated).groupBy("digest").agg(F.first("text").alias("text")))
    sent = spark.sparkContext.broadcast((tokenizer_path, model))  # one file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*sent.value)
        for batch in batches:
            column = batch.column(1)
            numbers = []
            for start, end in pieces(byte_view(column)[1], ENCODE_BYTES, 1 << 16):
                numbers += count(column.slice(start, end - start).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64())], names=["digest", "n_tokens"])

    counts = misses.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens bigint")
    counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    # Written, so that the join has no more to do than to meet its rows, and Spark may split those of a frequent text.
    numbers = written(texts.select("digest").join(read_cache(spark, cache_path, version), "digest"), "count-numbers")
    found = rows.join(counted(numbers, broadcast_rows), "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
