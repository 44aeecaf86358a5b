"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, run once over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, kinds, mapped, utf8, written

WINDOW = 10
#: Bytes of items that go into one automaton; more items take several, one after the other.
BLOCK_BYTES = 4 << 20

#: Each byte as it counts: A-Z in lower case, what is no part of a word as a space.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes from 0x80, in lower case for A-Z."""
    return text.translate(FOLDED).split()


def windows(text: bytes, length: int = WINDOW) -> list[bytes]:
    """Each run of `length` words, or all words of a text that has fewer."""
    found = words(text)
    return [b" ".join(found[i : i + length]) for i in range(max(len(found) - length, 0) + 1)] if found else []


def automaton(patterns: list[bytes]) -> ahocorasick.Automaton:
    """Finds each pattern between spaces; a match gives its place in the list."""
    found = ahocorasick.Automaton()
    for i, pattern in enumerate(patterns):
        found.add_word(f" {pattern.decode('latin-1')} ", i)
    found.make_automaton()
    return found


def hits(machine: ahocorasick.Automaton, sizes: list[int], found: list[bytes]) -> tuple[np.ndarray, set[int]]:
    """Which of the words lie in a match, and the patterns that match."""
    if not found or not sizes:
        return np.zeros(len(found), bool), set()
    line = f" {b' '.join(found).decode('latin-1')} "
    matches = list(machine.iter(line))
    if not matches:
        return np.zeros(len(found), bool), set()
    # The word after each space; a match ends with the space after its last word.
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in matches])
    first = last - np.array([sizes[i] for _, i in matches])
    change = np.bincount(first, minlength=len(found) + 1) - np.bincount(last, minlength=len(found) + 1)
    return np.cumsum(change)[:-1] > 0, {i for _, i in matches}


def spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as places in the original text, counted in characters."""
    is_word = np.frombuffer(text.translate(FOLDED), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    run = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    # Bytes 0x80-0xBF go on with a character that has begun.
    begun = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(begun[starts[a]]), "end": int(begun[ends[b - 1]])} for a, b in zip(run[::2], run[1::2], strict=True)]


def _patterns(benchmark: DataFrame, block: int, blocks: int, length: int) -> tuple[list[bytes], list[list[str]]]:
    """The windows of a block of items, each once, with the ids of the items that have it."""
    part = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8(F.col("text")).alias("text"))
    part = part.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
    items: dict[bytes, set[str]] = {}
    for row in part.collect():  # bounded by the size of a block
        for window in windows(bytes(row.text), length):
            items.setdefault(window, set()).update([] if row.item is None else [row.item])
    return list(items), [sorted(ids) for ids in items.values()]


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
         keep: list[str] | None = None) -> DataFrame:
    """The rows of `docs` (text and any other columns) and four more columns.

    n_words: words of the text. n_hit: those inside any occurrence of a window of a test item. items: ids, as
    strings, of the items with occurring windows, sorted. hit_spans: the runs of hit words as {start, end} in
    characters of the original text. A text that is null or has no word has none of them. An item without a word
    has no window; an item without an id marks words, but is not listed. Columns of these names are replaced;
    `keep` names the other columns to return, if not all.

    `benchmark` (item_id, text) is the given query set. Up to `block_bytes` of it make one automaton, which every
    task gets; a larger set is taken in so many blocks by a hash, each with a pass of its own.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    base = docs.drop("n_words", "n_hit", "items", "hit_spans")
    state = free_name(base.columns, "hit_words")
    out = base.select("*", F.lit(None).cast("binary").alias(state), F.expr("CAST(array() AS array<string>) AS items"))
    for block in range(blocks - 1):
        out = written(_searched(out, state, *_patterns(benchmark, block, blocks, window)), "decontam")
    kept = base.columns if keep is None else keep
    return _searched(out, state, *_patterns(benchmark, blocks - 1, blocks, window), final=kept)


def _searched(df: DataFrame, state: str, patterns: list[bytes], items: list[list[str]], final: list[str] | None = None) -> DataFrame:
    """Adds a block's hit words, as one bit each, and its items; with `final`, these columns and the results of all blocks."""
    names = df.columns
    at, mark, ids = (names.index(c) for c in ("text", state, "items"))
    sizes = [p.count(b" ") + 1 for p in patterns]
    sent = df.sparkSession.sparkContext.broadcast({"patterns": patterns, "sizes": sizes, "items": items})
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        if "machine" not in known:  # once for each worker
            known["machine"] = automaton(known["patterns"])
        for batch in batches:
            bits, listed, totals, counts, places = [], [], [], [], []
            for text, before, earlier in zip(batch.column(at).cast(pa.binary()), batch.column(mark).to_pylist(),
                                             batch.column(ids).to_pylist(), strict=True):
                text = text.as_py() or b""
                found = words(text)
                hit, matched = hits(known["machine"], known["sizes"], found)
                if before is not None:
                    hit |= np.unpackbits(np.frombuffer(before, np.uint8))[: len(hit)].astype(bool)
                n = int(hit.sum())
                listed.append(sorted({*earlier, *(x for i in matched for x in known["items"][i])}) if matched else earlier)
                if final is None:
                    bits.append(np.packbits(hit).tobytes() if n else None)
                else:
                    totals.append(len(found))
                    counts.append(n)
                    places.append(spans(text, hit) if n else [])
            columns = dict(zip(names, batch.columns, strict=True)) | {"items": pa.array(listed, pa.list_(pa.string()))}
            if final is None:
                columns[state] = pa.array(bits, pa.binary())
            else:
                columns = {c: columns[c] for c in [*final, "items"]}
                columns |= {"n_words": pa.array(totals, pa.int64()), "n_hit": pa.array(counts, pa.int64()), "hit_spans": pa.array(places, span)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    if final is None:
        return mapped(df, search, kinds(df))
    fields = kinds(df, [names.index(c) for c in [*final, "items"]])
    return mapped(df, search, [*fields, ("n_words", "bigint"), ("n_hit", "bigint"), ("hit_spans", "array<struct<start:int,end:int>>")])


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs` in which no window of a test item occurs, with their columns as they are."""
    names = docs.columns
    plain = docs.toDF(*("text" if c == "text" else f"c{i}" for i, c in enumerate(names)))
    clean = scan(plain, benchmark, **how).filter("n_hit = 0")
    return clean.drop("n_words", "n_hit", "items", "hit_spans").toDF(*names)
