import random

import numpy as np
import pytest

from burnish.llm import quality


def test_features_are_words_and_pairs():
    data = np.frombuffer(b"One two!! oneone|", np.uint8)
    hashed, owner = quality.features(data, np.array([0, 13, 13, 16, 17]), 1 << 30)
    of = lambda i: hashed[owner == i].tolist()
    assert [len(of(i)) for i in range(4)] == [7, 0, 1, 1]  # one two !! one, and three pairs
    assert of(0)[0] == of(0)[3] == of(2)[0]


def test_threshold_is_the_kth_largest(frame, monkeypatch):
    monkeypatch.setattr(quality, "BINS", 4)
    monkeypatch.setattr(quality, "FEW", 5)
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 0.5]) for _ in range(300)]
    keys = frame("key double", [(v,) for v in values])
    for k in (1, 2, 50, 150, 299, 300, 400):
        assert quality.threshold(keys, k) == sorted(values, reverse=True)[min(k, 300) - 1]
    assert quality.threshold(keys, 0) == float("inf") == quality.threshold(keys.limit(0), 3)


@pytest.fixture(scope="module")
def scored(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    # Half of the labels are kept back.
    teach = labels.filter("doc_id % 2 = 0")
    return quality.resample(docs, teach).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()


def test_unseen_good_documents_rank_higher(scored):
    good = [r.log_weight for r in scored if r.quality == 1]
    bad = [r.log_weight for r in scored if r.quality == 0]
    assert min(len(good), len(bad)) > 10
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([r.kept for r in scored if r.quality == 1]) > 0.9


def test_sampling_follows_the_weights(spark, frame):
    """With even weights, Gumbel top-k is a plain sample without replacement."""
    docs = frame("doc_id bigint, text string", [(i, f"word{i % 3}") for i in range(2000)])
    none = frame("doc_id bigint, quality int", [])
    rows = quality.resample(docs, none, share=0.25).collect()
    assert sum(r.kept for r in rows) == 500
    by = [sum(r.kept for r in rows if r.doc_id % 3 == k) for k in range(3)]
    assert all(120 < n < 215 for n in by)


def test_edge_rows(frame):
    docs = frame("doc_id bigint, text string, good_id int, kept string", [
        (1, "good words here", 1, ""), (1, "good words here", 2, ""), (2, None, 3, ""), (3, "", 4, ""), (4, "..", 5, ""), (None, "bad stuff", 6, ""),
        (5, "good " * 100_000, 7, ""), (6, "lone", 8, "")])
    labels = frame("doc_id bigint, quality int, toxic int", [(1, 1, 0), (1, 1, 0), (5, None, 0), (None, 1, 0), (6, 0, 0), (99, 1, 1)])
    rows = quality.resample(docs, labels, share=1.0).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in rows), key=repr) == sorted(
        [(1, 3, True), (1, 3, True), (2, 0, False), (3, 0, False), (4, 1, True), (None, 2, True), (5, 100_000, True), (6, 1, True)], key=repr)
    twice = [r.gumbel_key for r in rows if r.doc_id == 1]
    assert twice[0] == twice[1]
    assert quality.resample(docs.limit(0), labels).count() == 0
