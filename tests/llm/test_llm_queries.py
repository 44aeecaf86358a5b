import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import oracle

import __spark_entry__ as driver
import corpus_pipeline
from burnish.llm import decontam, exact, langid, minhash, spiece
from burnish.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, monkeypatch, name):
    monkeypatch.setattr(oracle, "UNWANTED", ("CartesianProduct", "BroadcastNestedLoopJoin"))
    assert oracle.compare(spark, oracle.connect(SF), SF, QUERIES[name], SQL[name]) is None


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())


def test_pipeline(spark):
    """Each stage against what its operator says of the rows that it got."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{corpus_pipeline.shared_dir(spark)}/test-{name}-{id(spark)}-{len(after)}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        after[name] = (docs, spark.read.parquet(path))
        docs = after[name][1]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, kept = after["language"]
    assert kept.count() >= 0.99 * before.count() and kept.columns == before.columns
    before, kept = after["exact_copies"]
    assert ids(kept) == ids(exact.groups(before).filter("kept"))
    before, kept = after["near_copies"]
    assert ids(kept) == ids(minhash.classes(before).filter("kept")) and kept.count() < before.count()
    before, kept = after["contamination"]
    assert ids(kept) == ids(decontam.scan(before, benchmark).filter("n_hit = 0")) and kept.count() < before.count()
    before, kept = after["pieces"]
    assert kept.columns == [*before.columns, "token_ids"]
    model = corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")
    assert spiece.decode(kept, model).filter("decoded != text").count() == 0
    assert ids(corpus_pipeline.run(spark, SF)) == ids(kept)


def test_language_stage_drops_what_has_no_language(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = frame(docs.schema, [(-1, None, None, None, None), (-2, "1234", "en", "s", 4)])
    kept = langid.keep_identified(docs.unionByName(odd))
    assert kept.filter("doc_id < 0").count() == 0


def test_stages_with_odd_columns(spark, frame):
    """A struct field with a blank, and names that differ from an operator's own in case alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = docs.selectExpr("*", "named_struct('a b', n_chars) AS `the struct`", "'x' AS `N_Words`", "1 AS Token_IDs", "2 AS `Lang_Pred`", "'y' AS KEEP_ID")
    folder = f"{corpus_pipeline.shared_dir(spark)}/odd-{id(odd)}"
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, "/root/testdata/sf0.001").write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        assert after.columns == (odd.columns if name != "pieces" else [*(c for c in odd.columns if c != "Token_IDs"), "token_ids"])
        assert after.filter("`the struct`.`a b` = n_chars").count() == after.count() > 0
        odd = after
