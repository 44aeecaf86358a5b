"""Conversations as training text: rendered whole, encoded once with offsets, the loss mask found by binary search.

A turn is `<turn>` role `<text>` text `</turn>` and a line feed. The three marks are tokens of their own, so no token
reaches across the border of a text. In roles and texts each backslash is doubled, and each mark or special string of
the tokenizer gets a backslash behind its first character; `unescaped` takes that back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from .common import mapped

#: Fixed values of the template.
TURN, TEXT, END, GAP = "<turn>", "<text>", "</turn>", "\n"
MARKS = (TURN, TEXT, END)
LEARNED_ROLE = "assistant"

#: Characters of a conversation from which on its next turn begins another part.
PART_CHARS = 1 << 20
#: Characters that are encoded at once.
ENCODE_CHARS = 1 << 19

_TURNS = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}{re.escape(GAP)}", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def tokenizer_of(model: str) -> tuple[Tokenizer, tuple[str, ...]]:
    """The tokenizer of a JSON file's text with the marks as tokens, and all strings that texts must not hold as they are."""
    tokenizer = Tokenizer.from_str(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if odd := [s for s in special if len(s) < 2 or "\\" in s]:
        raise ValueError(f"special strings that cannot be escaped: {odd}")
    tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])
    return tokenizer, (*MARKS, *(s for s in special if s not in MARKS))


def escaped(text: str, control: tuple[str, ...] = MARKS) -> str:
    text = text.replace("\\", "\\\\")
    for mark in control:
        text = text.replace(mark, f"{mark[0]}\\{mark[1:]}")
    return text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens, by their first and last places in the text, meet one of the sorted spans (start, end)."""
    spans = spans[spans[:, 0] < spans[:, 1]]
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, spans[:, 1], side="left")
    change = np.bincount(first, minlength=len(starts) + 1) - np.bincount(last, minlength=len(starts) + 1)
    return np.cumsum(change)[: len(starts)] > 0


def masked_runs(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """The runs of characters under the mask; tokens that share a character count it once."""
    starts, ends = starts[mask], ends[mask]
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[new].tolist(), reach[np.append(new[1:], len(starts)) - 1].tolist(), strict=True))


class _Part:
    """Turns of one conversation on their way to a rendered text."""

    def __init__(self, conv, number: int, whole: bool) -> None:
        self.conv, self.number, self.whole = conv, number, whole
        self.texts: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.size = 0

    def add(self, role: str, text: str, control: tuple[str, ...], learned: str) -> None:
        head, body = f"{TURN}{escaped(role, control)}{TEXT}", escaped(text, control)
        begin = self.size + len(head)
        if role == learned:
            self.spans.append((begin, begin + len(body)))
        self.texts.append(f"{head}{body}{END}{GAP}")
        self.size = begin + len(body) + len(END) + len(GAP)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), kind))


def _encoded(tokenizer: Tokenizer, parts: list[_Part], kind: pa.DataType) -> pa.RecordBatch:
    texts = ["".join(p.texts) for p in parts]
    ids, starts, ends, masks = [], [], [], []
    for part, found in zip(parts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        places = np.array(found.offsets, np.int32).reshape(-1, 2)
        ids.append(np.array(found.ids, np.int32))
        starts.append(places[:, 0])
        ends.append(places[:, 1])
        masks.append(loss_mask(places[:, 0], places[:, 1], np.array(part.spans, np.int64).reshape(-1, 2)))
    columns = [
        pa.array([p.conv for p in parts], kind), pa.array([p.number for p in parts], pa.int64()), pa.array([p.whole for p in parts]),
        pa.array(texts, pa.string()), _lists(ids, pa.int32()), _lists(starts, pa.int32()), _lists(ends, pa.int32()), _lists(masks, pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])


def format_conversations(turns: DataFrame, tokenizer_path: str, *, learned_role: str = LEARNED_ROLE,
                         part_chars: int = PART_CHARS, encode_chars: int = ENCODE_CHARS) -> DataFrame:
    """Conversations of `turns` (conv_id, turn, role, text; other columns do not matter) as training text.

    Returns conv_id, part, whole, formatted, token_ids, token_starts, token_ends (places in `formatted`, in characters)
    and loss_mask (one flag a token: is it part of a text of `learned_role`).

    Rows are ordered by `turn`, those without one first, equal turns by a hash of role and text; repeated rows are
    turns of their own. A null text or role is empty, a null conv_id an id like any other; no rows give no rows.
    A conversation is one row, with `whole` set, unless it is longer than `part_chars` or lies at the edge of a
    task's range; then its turns are in several rows, in the order of `part`, each a whole number of turns. As marks
    are tokens of their own, the tokens are those of the conversation in one piece. A long conversation is so spread
    over several tasks, and no task holds more than a part or one turn. The tokenizer's file travels in the job.
    """
    model = Path(tokenizer_path).read_text(encoding="utf-8")
    sent = turns.sparkSession.sparkContext.broadcast(model)  # one file
    kind = turns.schema["conv_id"].dataType
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("arrival", F.monotonically_increasing_id())
    rows = rows.orderBy("conv_id", "turn", F.xxhash64("role", "text"), "arrival").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer, control = tokenizer_of(sent.value)
        base, made = TaskContext.get().partitionId() << 32, 0
        ready: list[_Part] = []
        part, begun = None, False
        arrow = None
        for batch in batches:
            arrow = batch.column(0).type
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None or conv != part.conv or part.size >= part_chars:
                    same = part is not None and conv == part.conv
                    if part is not None:
                        part.whole = part.whole and not same
                        ready.append(part)
                    # The first conversation of a task may have begun in the one before.
                    part = _Part(conv, base + made, begun and not same)
                    begun, made = True, made + 1
                    if sum(p.size for p in ready) >= encode_chars:
                        yield _encoded(tokenizer, ready, arrow)
                        ready = []
                part.add(role, text, control, learned_role)
        if part is not None:
            part.whole = False  # it may go on in the next task
            yield _encoded(tokenizer, [*ready, part], arrow)

    fields = [("conv_id", kind.simpleString()), ("part", "bigint"), ("whole", "boolean"), ("formatted", "string"), ("token_ids", "array<int>"),
              ("token_starts", "array<int>"), ("token_ends", "array<int>"), ("loss_mask", "array<boolean>")]
    return mapped(rows, run, fields)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a rendered text."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURNS.finditer(formatted)]


def read_back(parts: DataFrame) -> DataFrame:
    """What the rows of `format_conversations` hold, in any order: one row for each conversation.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed of each turn), loss_chars and loss_sha256 (of
    the characters under the loss mask, unescaped), formatted_chars. Digests of conversations in several parts are
    carried from part to part, so no task holds more than one of them at once.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    wanted = parts.select("conv_id", "part", "whole", "formatted", "token_starts", "token_ends", "loss_mask")
    fields = [("conv_id", kind), ("part", "bigint"), ("n_turns", "bigint"), ("loss_chars", "bigint"), ("formatted_chars", "bigint"),
              ("turns", "binary"), ("loss", "binary"), ("whole", "boolean")]

    def numbers(column: pa.Array, row: int) -> np.ndarray:
        return column[row].values.to_numpy(zero_copy_only=False)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (part, whole, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                runs = masked_runs(*(numbers(batch.column(k), i) for k in (4, 5, 6)))
                loss = [unescaped(text[a:b]) for a, b in runs]
                said = read_turns(text)
                turns, learned = "".join(f"{r}\n{t}\n" for r, t in said).encode(), "".join(loss).encode()
                if whole:
                    turns, learned = hashlib.sha256(turns).digest(), hashlib.sha256(learned).digest()
                out.append((part, len(said), sum(map(len, loss)), len(text), turns, learned, whole))
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.bool_()]
            columns = [batch.column(0), *(pa.array(list(v), k) for v, k in zip(zip(*out, strict=True), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            done = []
            for row in range(batch.num_rows):
                conv, _, n, chars, size, turns, learned, whole = (c[row].as_py() for c in batch.columns)
                if whole:
                    done.append((conv, n, turns.hex(), chars, learned.hex(), size))
                    continue
                if held is not None and held[0] != conv:
                    done.append(_closed(held))
                    held = None
                if held is None:
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[1], held[3], held[5] = held[1] + n, held[3] + chars, held[5] + size
                held[2].update(turns)
                held[4].update(learned)
            if done:
                yield _digests(done, batch.column(0).type)
            kept = batch.column(0).type
        if held is not None:
            yield _digests([_closed(held)], kept)

    pieces = mapped(wanted, read, fields)
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return mapped(ordered, carry, [("conv_id", kind), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"),
                                   ("loss_sha256", "string"), ("formatted_chars", "bigint")])


def _closed(held: list) -> tuple:
    conv, n, turns, chars, learned, size = held
    return conv, n, turns.hexdigest(), chars, learned.hexdigest(), size


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(6)])
