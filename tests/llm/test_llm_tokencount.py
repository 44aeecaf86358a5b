from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from burnish.llm import tokencount
from burnish.llm.common import new_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(1, "some text"), (2, None), (3, ""), (4, "some text"), (5, "<s> special </s> <unk>"), (6, "word " * 30_000), (6, "word " * 30_000), (None, "é日本 \n x"), (None, None)]


def expected(count):
    return sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for i, t in ROWS), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_same_as_the_library_and_only_misses_are_encoded(spark, frame):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = new_path(spark, "test-cache")
    docs = frame("doc_id bigint, text string, n_tokens int", [(*r, 0) for r in ROWS])
    assert rows_of(tokencount.count_tokens(docs, PIECES, cache)) == expected(lambda t: len(library.encode(t)))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in ROWS})
    more = docs.unionByName(frame("doc_id bigint, text string, n_tokens int", [(9, "new text", 0)]))
    assert tokencount.count_tokens(more, PIECES, cache).count() == len(ROWS) + 1
    assert spark.read.parquet(cache).count() == stored.count() + 1


def test_a_stored_count_is_used(spark, frame):
    cache = new_path(spark, "test-cache")
    docs = frame("doc_id bigint, text string", [(1, "some text")])
    tokencount.count_tokens(docs, PIECES, cache)
    known = spark.read.parquet(cache).selectExpr("tokenizer", "digest", "n_tokens + 100 AS n_tokens").collect()
    spark.createDataFrame(known, tokencount.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert tokencount.count_tokens(docs, PIECES, cache).first().n_tokens > 100


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_have_rows_of_their_own(spark, frame, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_str(Path(path).read_text())
    cache = new_path(spark, "test-cache")
    docs = frame("doc_id bigint, text string", ROWS)
    tokencount.count_tokens(docs, PIECES, cache)
    got = rows_of(tokencount.count_tokens(docs, path, cache, broadcast_rows=0))
    assert got == expected(lambda t: len(library.encode(t, add_special_tokens=False).ids))


def test_empty_table(spark, frame):
    assert tokencount.count_tokens(frame("doc_id bigint, text string", []), PIECES, new_path(spark, "test-cache")).count() == 0
