import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.llm import target


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets(text, n, max_run):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, max_run + 1) for i in range(len(w) - k + 1)]


def brute(docs, items, percent, min_words, max_run, n):
    s = Counter(b for _, t in docs for b in buckets(t, n, max_run))
    t = Counter(b for x in items for b in buckets(x, n, max_run))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n)))) for b in range(n)]
    rows = []
    for i, text in docs:
        found = buckets(text, n, max_run)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], -(2**63) if r[0] is None else r[0], r[1]))
    drawn = [(*r[:4], k) for k, r in enumerate(able, 1) if k <= percent * len(able) // 100]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted([*drawn, *((*r, None) for r in left.elements())], key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("max_run", [1, 3])
@pytest.mark.parametrize("block", [1 << 20, 9])
def test_against_brute_force(frame, monkeypatch, max_run, block):
    monkeypatch.setattr(target, "BLOCK", block)
    monkeypatch.setattr(target, "LONG_WORD", 8)
    rng = random.Random(1)
    known = ["an", "É1", "Zz", "longer-word", "extraordinarily", "9", "été"]
    docs = [(i, " ".join(rng.choice(known) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    docs += [(None, "an an an"), (None, None), (3, docs[3][1]), (3, docs[3][1]), (5, "zz É1"), (90, ""), (91, " ,. "), (92, "word " * 3_000)]
    items = ["an É1 zz", None, "", "longer word"]
    df = frame("Rank int, doc_id bigint, text string, `a b` string", [(1, *d, "") for d in docs]).repartition(3)
    got = target.resample(df, frame("item_id bigint, text string", list(enumerate(items))), percent=40, min_words=2, max_run=max_run, buckets=50)
    assert rows_of(got) == brute(docs, items, 40, 2, max_run, 50)


def test_empty_tables(frame):
    docs, items = frame("doc_id bigint, text string", []), frame("item_id bigint, text string", [])
    assert target.resample(docs, items).count() == 0
    one = frame("doc_id bigint, text string", [(1, "a b c"), (2, None)])
    assert rows_of(target.resample(one, items, percent=100, min_words=1, buckets=10)) == brute([(1, "a b c"), (2, None)], [], 100, 1, 1, 10)


def test_repeated_rows_at_the_cutoff(frame):
    docs = [(1, "same words")] * 9 + [(2, None)]
    got = target.resample(frame("doc_id bigint, text string", docs), frame("item_id bigint, text string", []), percent=50, min_words=1)
    assert sorted((r.rank for r in got.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 4, *[None] * 6]


@pytest.mark.parametrize("kind", ["many", "few", "one"])
def test_cutoff_is_the_kth_largest(spark, monkeypatch, kind):
    monkeypatch.setattr(target, "MEDIAN_ROWS", 100)
    spread = {"many": 10**12, "few": 7, "one": 1}[kind]
    keys = spark.range(5_000, numPartitions=7).select(F.pmod(F.xxhash64("id"), F.lit(spread)).alias("key"))
    ordered = sorted((r.key for r in keys.collect()), reverse=True)
    for k in (1, 2, 999, 2_500, 5_000):
        least, ties = target.cutoff(keys, k, few=20)
        assert least == ordered[k - 1] and ties == k - sum(x > least for x in ordered)


def test_rounds_leave_out_a_quarter():
    rng = np.random.default_rng(4)
    blocks = [np.sort(rng.normal(rng.normal(), 1, rng.integers(1, 300)) * 1e6).astype(np.int64) for _ in range(40)]
    pivot = target._weighted_median([(int(b[len(b) // 2]), len(b)) for b in blocks])
    every = np.concatenate(blocks)
    assert 0.2 < np.mean(every <= pivot) and 0.2 < np.mean(every >= pivot)
