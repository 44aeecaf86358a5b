import hashlib
import random

import pytest

from burnish.llm import suffix


def brute(rows, length):
    """rows: (doc_id, text), in the order that counts."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                mark[k : k + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, m in zip(data, mark, strict=True) if not m)
        spans = sum(1 for k in range(len(data)) if mark[k] and not (k and mark[k - 1]))
        out.append((i, len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(docs, **how):
    return sorted((tuple(r)[:5] for r in suffix.remove_repeats(docs, **how).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [rng.choice("abcdefgéß日") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = text(40), text(9)
    rows = [(1, None), (2, ""), (3, passage), (4, passage), (5, text(10) + passage + text(10)), (6, passage[:50]),
            (7, "ab" * 400), (8, "a" * 500), (9, text(30) + line * 3)]
    rows += [(10 + k, text(rng.randint(0, 30)) + " " + passage[rng.randint(0, 60) :] + text(5)) for k in range(25)]
    return [*rows, (40, text(3000) + passage), (None, passage + "end")]


@pytest.mark.parametrize("length, gram, group_rows", [(100, 32, 20_000), (100, 32, 1), (20, 8, 5)])
def test_same_as_brute_force(frame, rows, length, gram, group_rows):
    docs = frame("doc_id bigint, text string", random.Random(1).sample(rows, len(rows)))
    assert found(docs, length=length, gram=gram, group_rows=group_rows) == brute(rows, length)


def test_long_texts_in_parts_and_without_broadcasts(frame, rows, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 64)
    docs = frame("doc_id bigint, text string", rows)
    assert found(docs, broadcast_rows=0) == brute(rows, 100)


def test_repeated_rows_are_one_document(frame):
    text, other = "some words here " * 5 + "a" * 100, "b" * 150
    docs = frame("doc_id bigint, text string, twin string", [(1, text, "x"), (1, text, "y"), (2, other, None), (2, text, None)])
    result = found(docs)
    assert result[0] == result[1] and result[0][2] == brute([(1, text)], 100)[0][2]
    assert sorted(r[2] for r in result if r[0] == 2) == sorted([brute([(2, other)], 100)[0][2], len(text)])


def test_text_that_is_left(frame):
    line = "0123456789" * 10
    rows = suffix.remove_repeats(frame("doc_id bigint, text string", [(1, line + "é"), (2, "<" + line + ">")]), with_text=True).collect()
    assert {r.doc_id: bytes(r.kept_text).decode() for r in rows} == {1: line + "é", 2: "<>"}


def test_empty_table(frame):
    assert suffix.remove_repeats(frame("doc_id bigint, text string", [])).count() == 0
