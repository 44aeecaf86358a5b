import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from burnish.llm import exact

ROWS = [
    (3, "a  b"), (1, "a b"), (2, "a\t\n b"), (4, "a b "), (5, ""), (6, None), (7, "\x0b"), (8, " "), (9, "x" * 300_000),
    (9, "x" * 300_000), (9, "y"), (None, "a b"), (None, "only"), (None, "only"), (10, " b"), (11, "a\x1cb"),
]


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for normal, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        done = False
        for i in ids:
            first = i == keep and not done
            done = done or first
            out.append((i, keep, len(ids), first, hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def docs(frame):
    return frame("doc_id bigint, text string", ROWS)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_same_as_brute_force(docs):
    assert rows_of(exact.groups(docs)) == brute(ROWS)


def test_collisions_change_nothing(docs):
    one = exact.groups(docs, digest=lambda normal: F.unhex(F.lit("00")))
    assert rows_of(one) == brute(ROWS)


def test_without_broadcasts(docs):
    assert rows_of(exact.groups(docs, broadcast_rows=0)) == brute(ROWS)


def test_a_large_group_is_split(frame, monkeypatch):
    monkeypatch.setattr(exact, "PART_ROWS", 7)
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(120)]
    assert rows_of(exact.groups(frame("doc_id bigint, text string", rows))) == brute(rows)


def test_empty_table(frame):
    empty = frame("doc_id bigint, text string", [])
    assert exact.groups(empty).count() == 0
    assert exact.keep_first(empty).count() == 0


def test_keep_first_keeps_one_row_of_each_and_all_columns(frame):
    rows = [(i, t, f"x{i}", "k") for i, t in ROWS]
    docs = frame("doc_id bigint, text string, digest string, key_id string", rows)
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    want = sorted((i for i, _, _, first, _ in brute(ROWS) if first), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_no_python_in_the_plan(docs):
    plan = exact.groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
