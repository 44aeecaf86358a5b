import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from burnish.llm import shards


def smallest(sizes, n):
    def fits(capacity):
        used, now = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if now + s > capacity:
                used, now = used + 1, 0
            now += s
        return used <= n

    low, high = 0, sum(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def check(rows, result, n):
    texts = {i: t or "" for i, t in rows}
    assert sorted(r.doc_id for r in result) == sorted(texts)
    groups = defaultdict(int)
    for t in texts.values():
        groups[hashlib.md5(t.encode()).hexdigest()] += len(t.encode()) + 1
    used, place, slots = Counter(), {}, defaultdict(list)
    for r in result:
        t = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        assert place.setdefault(t, r.shard) == r.shard and 0 <= r.shard < n
        used[r.shard] += r.size
        slots[r.shard].append(r.slot)
    ordered = [groups[k] for k in sorted(groups)]
    assert max(used.values()) <= smallest(ordered, n)
    by_hash = [place[t] for t in sorted(set(texts.values()), key=lambda t: hashlib.md5(t.encode()).hexdigest())]
    assert by_hash == sorted(by_hash)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return used


@pytest.mark.parametrize("seed, n", [(1, 16), (2, 5), (3, 1)])
def test_smallest_capacity(frame, seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", None, "x" * rng.randint(1, 500), f"copy {rng.randint(0, 9)}"])) for i in range(400)]
    check(rows, shards.shard(frame("doc_id bigint, text string, shard string", [(*r, "s") for r in rows]), n).collect(), n)


def test_ranges_are_split_until_cuts_fall_between_groups(frame, monkeypatch):
    monkeypatch.setattr(shards, "FIRST_DIGITS", 1)
    monkeypatch.setattr(shards, "MORE_DIGITS", 1)
    rows = [(i, f"text {i} " * (i % 7)) for i in range(300)]
    used = check(rows, shards.shard(frame("doc_id bigint, text string", rows), 16).collect(), 16)
    assert len(used) == 16


def test_one_large_group_leaves_the_rest_even(frame):
    rows = [(i, "the same text of the group" * 4) for i in range(500)] + [(1000 + i, f"text {i} " * 3) for i in range(900)]
    used = check(rows, shards.shard(frame("doc_id bigint, text string", rows), 16).collect(), 16)
    rest = sorted(used.values())[:-1]
    assert len(rest) == 15 and rest[-1] < 1.3 * sum(rest) / 15


def test_repeated_and_missing_ids(frame):
    docs = frame("doc_id bigint, text string", [(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "")])
    rows = shards.shard(docs, 2).collect()
    assert sorted(r.size for r in rows) == [1, 1, 2, 2, 2]
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_empty_table(frame):
    assert shards.shard(frame("doc_id bigint, text string", [])).count() == 0
