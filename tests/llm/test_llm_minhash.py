import random
import re
from collections import Counter

import numpy as np
import pytest

from burnish.llm import minhash
from burnish.llm.components import components
from burnish.llm.words import FOLDED, word_hashes


def test_words_are_found_as_the_pattern_finds_them():
    texts = ["Ab cd-ef", "", "é日 x_9", "A" * 5, "  ", "tail"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    hashes, counts = word_hashes(data, ends)
    found = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(FOLDED[list(t.encode())]).lower() if t else b"") for t in texts]
    assert counts.tolist() == [len(f) for f in found]
    flat = [w for f in found for w in f]
    assert len({(w, int(h)) for w, h in zip(flat, hashes, strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_blocks_do_not_change_words(monkeypatch):
    data = np.frombuffer(("some words " * 50 + "x" * 90).encode(), np.uint8)
    ends = np.array([0, 200, 200, len(data)])
    whole = word_hashes(data, ends)
    monkeypatch.setattr("burnish.llm.words.BLOCK", 16)
    parts = word_hashes(data, ends)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**53, 300).astype(np.uint64)
    one, two = rng.uniform(1, 3, 300).astype(np.float32), rng.uniform(1, 3, 300).astype(np.float32)
    random_draws = minhash.draws(2000)
    first, second = (minhash.consistent_samples(hashes, w, np.array([0]), random_draws)[:, 0] for w in (one, two))
    similar = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((first == second).mean() - similar) < 0.04


def brute(rows, idf, similarity=0.8):
    sets = []
    for _, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        h, t, _ = minhash.weighted_sets(data, np.array([0, len(data)]))
        sets.append(dict(zip(h.tolist(), minhash.weights(h, t, idf).tolist(), strict=True)))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = sum(min(w, sets[b][k]) for k, w in sets[a].items() if k in sets[b])
            total = sum(sets[a].values()) + sum(sets[b].values()) - common
            if total and common / total >= similarity:
                parent[top(a)] = top(b)
    groups = {}
    for x in range(len(rows)):
        groups.setdefault(top(x), []).append(rows[x][0])
    return {x: min((i for i in groups[top(x)] if i is not None), default=None) for x in range(len(rows))}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(200)]
    for k in range(40):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(200)] = word()
        rows.append((k, " ".join(copy)))
    chain = [word() for _ in range(300)]
    for k in range(8):  # each like the next, the ends unlike
        rows.append((100 + k, " ".join(chain[k * 12 : k * 12 + 200])))
    rows += [(200 + k, " ".join(word() for _ in range(rng.randint(1, 80)))) for k in range(60)]
    rows += [(300, "one two"), (301, "One, two!"), (302, "one two three"), (303, ""), (304, None), (305, "..."), (306, "same " * 50),
             (307, "same " * 50), (308, "same " * 49)]
    return rows


def test_same_classes_as_brute_force(frame, rows):
    docs = frame("doc_id bigint, text string, label string", [(*r, "x") for r in random.Random(1).sample(rows, len(rows))])
    idf = minhash.idf_table(docs)
    want = {rows[x][0]: c for x, c in brute(rows, idf).items()}
    got = minhash.classes(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_without_broadcasts_and_with_small_parts(frame, rows, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    docs = frame("doc_id bigint, text string", rows)
    want = {rows[x][0]: c for x, c in brute(rows, minhash.idf_table(docs)).items()}
    assert {r.doc_id: r.class_id for r in minhash.classes(docs, broadcast_rows=0).collect()} == want


def test_repeated_and_missing_ids(frame):
    text, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    docs = frame("doc_id bigint, text string, key_id int", [(1, text, 0), (1, text, 1), (1, other, 2), (2, other, 3), (None, text, 4), (None, "lone words", 5)])
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in minhash.classes(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (1, 1, 2, True), (2, 1, 2, False), (None, 1, 3, False), (None, None, 1, True)], key=repr)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.key_id for r in kept.collect()) == [0, 1, 2, 5]


def test_empty_table(frame):
    assert minhash.classes(frame("doc_id bigint, text string", [])).count() == 0


def test_components_of_a_long_path(spark, frame):
    n = 200
    order = random.Random(4).sample(range(n), n)
    links = frame("a bigint, b bigint", [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (5000, 5000)])
    labels = {r.node: r.label for r in components(links).collect()}
    assert labels == {**dict.fromkeys(range(n), 0), **dict.fromkeys((1000, 1001, 1002), 1000)}


def templated(groups, seed=5):
    """Pages of one template, in pairs that are little more alike than others: about 0.82 and 0.74."""
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    base, rows = words(300), []
    for _ in range(groups):
        shared = words(10)
        rows += [(len(rows) + k, f"{base} {shared} {words(13)}") for k in range(2)]
    return rows


def met_and_alike(docs, rows, idf):
    """Classes of the pairs that share a bucket and are similar enough, by all pairs: label of each row."""
    keys = {r.doc_id: r["keys"] for r in minhash.signatures(docs, idf).collect()}
    sets = {}
    for i, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        h, t, _ = minhash.weighted_sets(data, np.array([0, len(data)]))
        sets[i] = (h, minhash.weights(h, t, idf).astype(np.float64))
    label, links = {i: i for i in sets}, 0
    for a in sets:
        for b in range(a):
            if any(x == y for x, y in zip(keys[a], keys[b], strict=True)):
                _, at, to = np.intersect1d(sets[a][0], sets[b][0], return_indices=True)
                common = np.minimum(sets[a][1][at], sets[b][1][to]).sum()
                if common / (sets[a][1].sum() + sets[b][1].sum() - common) >= minhash.SIMILARITY:
                    links += 1
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = {i: new if x == old else x for i, x in label.items()}
    return label, links


@pytest.mark.parametrize("members", [256, 16])
def test_all_similar_pairs_of_a_bucket_are_found_in_a_templated_group(frame, monkeypatch, members):
    monkeypatch.setattr(minhash, "MEMBERS", members)
    rows = templated(150)
    docs = frame("doc_id bigint, text string", rows)
    want, links = met_and_alike(docs, rows, minhash.idf_table(docs))
    assert links >= 100 and len(set(want.values())) > 100
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == want
