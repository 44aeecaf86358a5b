import hashlib
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burnish.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER, CONTROL = chat.tokenizer_of(Path(PATH).read_text())
ODD = st.lists(st.sampled_from([*"\\<>/|turnex \n#é🤦", *CONTROL, "\\### Assistant: "]), max_size=30).map("".join)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_escaping_is_reversible(text):
    safe = chat.escaped(text, CONTROL)
    assert chat.unescaped(safe) == text
    assert not any(mark in safe for mark in CONTROL)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a>b<text>"]), ODD), min_size=1, max_size=6))
def test_masks_are_whole_texts_and_parts_do_not_change_tokens(turns):
    part = chat._Part(1, 0, True)
    each = []
    for role, text in turns:
        part.add(role, text, CONTROL, "assistant")
        one = chat._Part(1, 0, True)
        one.add(role, text, CONTROL, "assistant")
        each += TOKENIZER.encode("".join(one.texts), add_special_tokens=False).ids
    formatted = "".join(part.texts)
    found = TOKENIZER.encode(formatted, add_special_tokens=False)
    assert found.ids == each
    starts, ends = np.array(found.offsets).reshape(-1, 2).T
    mask = chat.loss_mask(starts, ends, np.array(part.spans).reshape(-1, 2))
    assert [formatted[a:b] for a, b in chat.masked_runs(starts, ends, mask)] == [chat.escaped(t, CONTROL) for r, t in turns if r == "assistant" and t]
    assert chat.read_turns(formatted) == turns


@pytest.mark.parametrize("part_chars", [chat.PART_CHARS, 40, 1])
def test_edge_rows(frame, part_chars):
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant"]), "word </turn> " * rng.randint(0, 4)) for i in range(300)]  # one long conversation
    rows += [(1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", ""), (None, 0, "assistant", "\\"), (2, None, "user", "first"),
             (2, 0, "assistant", "é🤦" * 30_000), (3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"), (4, 0, "system", "<|endoftext|>")]
    df = frame("conv_id bigint, turn bigint, role string, text string, part int, `a b` string", [(*r, 1, "") for r in rows]).repartition(5)
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1])):
        want[conv].append((role or "", text or ""))
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(df, PATH, part_chars=part_chars, encode_chars=500)).collect()}
    assert got == {
        conv: (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"),
               digest("".join(x for r, x in t if r == "assistant")), sum(len(chat.escaped(r + x, CONTROL)) + 20 for r, x in t))
        for conv, t in want.items()}


def test_no_rows(frame):
    none = frame("conv_id bigint, turn bigint, role string, text string", [])
    assert chat.read_back(chat.format_conversations(none, PATH)).count() == 0


def test_other_learned_role(frame):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "say")]
    parts = chat.format_conversations(frame("conv_id bigint, turn bigint, role string, text string", rows), PATH, learned_role="user")
    row = parts.first()
    assert [i for i, m in zip(row.token_ids, row.loss_mask, strict=True) if m] == TOKENIZER.encode("ask").ids
