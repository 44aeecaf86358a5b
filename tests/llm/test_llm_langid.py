import numpy as np
import pytest

from burnish.llm import langid


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in langid.start_weights(3, hidden=4, seed=1).items()}
    x = rng.integers(97, 103, (7, 5)).astype(np.uint8)
    real = np.ones(x.shape, bool)
    real[4:, 2] = False
    label = np.array([0, 1, 2, 1, 0])
    _, grad = langid.gradients(w, x, real, label)
    for name, values in w.items():
        at = tuple(rng.integers(0, n) for n in values.shape) if name[1:2] != "x" else (int(x[1, 0]), 0)
        keep, step = values[at], 1e-6
        values[at] = keep + step
        up = langid.gradients(w, x, real, label)[0]
        values[at] = keep - step
        down = langid.gradients(w, x, real, label)[0]
        values[at] = keep
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-6), name


def test_segments_hold_every_byte_once():
    data = np.frombuffer(b"abcdefghij", np.uint8)
    x, real, owner = langid.segments(data, np.array([0, 0, 7, 10]), length=4)
    assert [bytes(row[r]) for row, r in zip(x, real, strict=True)] == [b"abcd", b"efg", b"hij"]
    assert owner.tolist() == [1, 1, 2]


def test_a_long_text_is_pooled_over_all_of_it(monkeypatch):
    model = langid.LanguageModel(["a", "b"], langid.start_weights(2))
    data = np.frombuffer(b"some words and more " * 400, np.uint8)
    whole = langid.pooled(model, data, np.array([0, len(data)]))
    parts = langid.pooled(model, data, np.array([0, len(data)]), width=3)
    assert np.allclose(whole, parts, atol=1e-5)
    assert whole.sum() == pytest.approx(1, abs=1e-5)


@pytest.fixture(scope="module")
def identified(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()


def test_held_out_accuracy(identified):
    _, rows = identified
    unseen = [r for r in rows if r.held_out]
    assert 150 < len(unseen) < 350
    assert sum(r.lang == r.lang_pred for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark, identified):
    from pyspark.sql import functions as F

    docs, rows = identified
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    again = {r.doc_id: r.lang_pred for r in langid.identify(other).collect()}
    assert again == {r.doc_id: r.lang_pred for r in rows}


def test_edge_rows(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = frame("doc_id bigint, text string, lang string",
                [(-1, None, "en"), (-2, "", None), (-3, "12 .. 3", None), (-4, "the " * 100_000, None), (None, "the of and", "en"), (-4, "the", None)])
    rows = langid.identify(docs.unionByName(odd)).filter("doc_id < 0 or doc_id is null").collect()
    assert len(rows) == 6
    by = {(r.doc_id, r.lang_pred) for r in rows}
    assert {(-1, "und"), (-2, "und"), (-3, "und")} <= by
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert sum(r.lang_pred == "en" for r in rows) == 3


def test_nothing_to_learn_from(frame):
    none = frame("doc_id bigint, text string, lang string", [])
    assert langid.identify(none).count() == 0
    rows = langid.identify(frame("doc_id bigint, text string, lang string", [(1, "words", None)])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]


def test_kept_rows_have_their_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.select("*", F.lit("mine").alias("score"), F.lit(1).alias("a.b"))
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit("123")))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.filter("score = 'mine'").count() == kept.count() >= docs.count() - 10
    assert kept.filter("text = '123'").count() == 0


def test_without_a_language_to_learn_every_text_with_a_letter_is_kept(frame):
    docs = frame("doc_id bigint, text string, lang string", [(1, "some words", None), (2, "12 3", None), (3, "é", None), (4, None, None), (5, "", None)])
    assert sorted(r.doc_id for r in langid.keep_identified(docs).collect()) == [1, 3]
