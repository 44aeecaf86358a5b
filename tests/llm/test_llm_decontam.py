import re

import pytest
from pyspark.sql import functions as F

from burnish.llm import decontam

LONG = " ".join(f"item{i}" for i in range(14))
ITEMS = [(1, LONG), (2, "Short, item!"), (3, None), (4, "..."), (5, "short item"), (None, "without id"), (5, "short item"), (6, "é日本 Ünder x")]
DOCS = [
    (1, "Nothing here"), (2, None), (3, ""), (4, "a SHORT item and a short-item."), (5, "shortitem short items"),
    (6, "x " + " ".join(f"item{i}" for i in range(3, 14)) + " y"), (7, LONG.upper() + " " + LONG), (8, " ".join(f"item{i}" for i in range(9))),
    (9, "é日本\tÜnder--x"), (10, "short item short"), (11, "without id"), (12, "w " * 100_000 + "short item"), (None, "short item"), (4, "short item"),
]
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, length=10):
    out = []
    for i, text in docs:
        words = [m for m in PATTERN.finditer(lower(text))]
        plain, hit, listed = [m.group() for m in words], set(), set()
        for item, item_text in items:
            own = PATTERN.findall(lower(item_text))
            n = min(len(own), length)
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(plain) - n + 1) if own else ():
                if tuple(plain[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    listed |= set() if item is None else {str(item)}
        spans = []
        for k in sorted(hit):
            if spans and k - 1 in hit:
                spans[-1] = (spans[-1][0], words[k].end())
            else:
                spans.append((words[k].start(), words[k].end()))
        out.append((i, len(plain), len(hit), sorted(listed), spans))
    return sorted(out, key=repr)


def found(df):
    rows = df.select("doc_id", "n_words", "n_hit", "items", "hit_spans").collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [(s.start, s.end) for s in r.hit_spans]) for r in rows), key=repr)


@pytest.fixture
def tables(frame):
    return frame("doc_id bigint, text string", DOCS), frame("item_id bigint, text string", ITEMS)


def test_same_as_brute_force(tables):
    assert found(decontam.scan(*tables)) == brute(DOCS, ITEMS)


def test_blocks_of_items_change_nothing(tables):
    assert found(decontam.scan(*tables, block_bytes=20)) == brute(DOCS, ITEMS)


def test_other_columns_stay(tables):
    docs, items = tables
    wide = docs.select("*", F.lit("mine").alias("hit_words"), F.lit("old").alias("items"), F.lit(1).alias("a.b"))
    assert decontam.scan(wide, items).columns[:4] == ["doc_id", "text", "hit_words", "a.b"]
    kept = decontam.keep_clean(wide, items)
    assert kept.columns == wide.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [r[0] for r in brute(DOCS, ITEMS) if not r[2]]
    assert kept.filter("items = 'old'").count() == kept.count()


def test_empty_tables(frame, tables):
    docs, items = tables
    none = frame("item_id bigint, text string", [])
    assert decontam.scan(docs, none).filter("n_hit > 0").count() == 0
    assert decontam.scan(docs, none).count() == len(DOCS)
    assert decontam.scan(docs.limit(0), items).count() == 0
