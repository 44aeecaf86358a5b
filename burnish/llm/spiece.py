"""SentencePiece encoding and decoding by weighted transducers and a shortest path.

A model file is compiled into three machines, kept as arrays:

* the normaliser, one state that reads a character and writes its symbol, with U+2581 for a space and one more before
  the text;
* the pieces, a trie over symbols whose accepting states write a piece for its weight, with an arc of bytes for a
  character that is no piece;
* the borders, whose state is the last piece: the weight of a piece after another.

Composed with a text they give a lattice of arcs, from the place where a piece starts to the place where it ends. Its
shortest path over the (min, +) semiring is the encoding. In a model of unigrams a piece weighs its negative log
probability and borders weigh nothing. A model of merges follows no weights of single pieces; there a piece weighs
nothing and a border infinitely much if a merge across it would have come before the merges that made its two sides.

All distinct runs of a block of text, which no piece reaches out of, are relaxed together, place by place.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_format

from .common import byte_view, kinds, mapped, pieces
from .words import mixed

SPACE = "▁"
NEVER = np.iinfo(np.int32).max
#: More than the ids of any model; two ids make one number.
BORDER = 1 << 24
#: The arc of a character without a piece, and a place that no arc has reached.
BYTES, NONE = -1, -2
#: Bytes of text that are taken at once, in so many rows at most.
BLOCK_BYTES, BLOCK_ROWS = 1 << 21, 1 << 14
#: Entries of a worker's memories of short runs (49 bytes each) and of borders (8 bytes), by a hash; a newer one takes
#: the place of an older one.
MEMORY_SLOTS, BORDER_SLOTS = 1 << 19, 1 << 19
#: Characters of runs that are relaxed together, and of a run from which on it is relaxed on its own.
SOLVE_CHARS, LONG_RUN = 1 << 17, 256


def _merged(text: str, score: dict[str, float]) -> tuple[list[str], dict[str, tuple[str, str]]]:
    """The model's own rule for one short piece: merge the best pair, the leftmost of equals, until none is left."""
    parts, made = list(text), {}
    while True:
        pairs = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
        if not pairs:
            return parts, made
        i = min(pairs)[1]
        made[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def _spine(piece: str, side: int, made: dict, ids: dict, order: dict, score: dict) -> list[tuple[int, int, int]]:
    """What stands at that side of a piece while it is made, the latest first: (id, since when, until when)."""
    until, found = NEVER, []
    while True:
        since = order[score[piece]] if len(piece) > 1 else -1
        found.append((ids[piece], since, until))
        if piece not in made:
            return found
        piece, until = made[piece][side], since


def compiled(model: bytes) -> dict:
    """The machines of a model file, as arrays."""
    spec = model_format.ModelProto()
    spec.ParseFromString(model)
    kind = type(spec.pieces[0])
    rules, trained = spec.normalizer_spec, spec.trainer_spec
    merging = trained.model_type == trained.BPE
    if not (merging or trained.model_type == trained.UNIGRAM) or not trained.byte_fallback:
        raise ValueError("only models of merges or unigrams with bytes as a fallback are supported")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("only models that keep characters and spaces as they are are supported")
    if any(p.type == kind.USER_DEFINED for p in spec.pieces):
        raise ValueError("only models without pieces of the user's own are supported")
    ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
    score = {p: spec.pieces[i].score for p, i in ids.items()}
    machine = _merge_machine(ids, score, len(spec.pieces)) if merging else {"weights": np.zeros(len(spec.pieces) + 1), "arcs": dict(ids)}
    if not merging:
        machine["weights"][list(ids.values())] = [-s for s in score.values()]
        machine["weights"][BYTES] = 10.0 - min(score.values(), default=0.0)  # fixed value: how much worse than the worst piece

    # Symbols are the characters of pieces; nodes are numbered in the order of their first piece.
    symbols = {c: k for k, c in enumerate(sorted({c for p in machine["arcs"] for c in p} | {SPACE}), 1)}
    step, leaf = {}, {}
    for piece, i in machine.pop("arcs").items():
        node = 0
        for c in piece:
            node = step.setdefault((node, symbols[c]), len(step) + 1)
        leaf[node] = i
    keys = np.array([n * BORDER + s for n, s in step], np.int64)
    order = np.argsort(keys)
    accepts = np.full(len(step) + 1, NONE, np.int32)
    accepts[list(leaf)] = list(leaf.values())
    roots = np.zeros(len(symbols) + 1, np.int64)
    for (n, k), child in step.items():
        if n == 0:
            roots[k] = child
    normaliser = np.zeros(0x110000, np.int32)
    for c, k in symbols.items():
        normaliser[ord(c)] = k
    normaliser[ord(" ")] = symbols[SPACE]
    raw = [p.piece.replace(SPACE, " ").encode() if p.type == kind.NORMAL else b"" for p in spec.pieces]
    byte_ids = np.zeros(256, np.int32)
    for i, p in enumerate(spec.pieces):
        if p.type == kind.BYTE:
            raw[i] = bytes([int(p.piece[3:5], 16)])
            byte_ids[raw[i][0]] = i
    return machine | {
        "normaliser": normaliser, "space": symbols[SPACE], "prefix": rules.add_dummy_prefix,
        "keys": keys[order], "nodes": np.array(list(step.values()), np.int64)[order], "accepts": accepts, "roots": roots,
        "bytes": byte_ids, "raw": pa.array(raw, pa.large_binary()),
        # A piece that goes on behind a space reaches out of a run; then a text is one run.
        "whole": any(SPACE in p.lstrip(SPACE) for p in ids),
    }


def _merge_machine(ids: dict[str, int], score: dict[str, float], n: int) -> dict:
    if missing := {c for p in ids for c in p} - ids.keys():
        raise ValueError(f"characters of pieces that are no pieces: {sorted(missing)[:5]}")
    # When a piece is made: the rank of its score. Single characters are there from the start.
    order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    merges, arcs = {}, {}
    sides: list[list[list]] = [[[]] * n, [[]] * n]
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            if piece[:k] in ids and piece[k:] in ids:
                merges[ids[piece[:k]] * BORDER + ids[piece[k:]]] = order[score[piece]]
        parts, made = _merged(piece, score)
        if len(parts) == 1:
            arcs[piece] = i
            for side in (0, 1):
                sides[side][i] = _spine(piece, side, made, ids, order, score)
    keys = np.array(sorted(merges), np.int64)
    spines = []
    for side in sides:
        starts = np.concatenate([[0], np.cumsum([len(s) for s in side])]).astype(np.int64)
        spines.append((starts, np.array([x for s in side for x in s], np.int64).reshape(-1, 3)))
    return {"weights": np.zeros(n + 1), "arcs": arcs, "merges": keys, "made": np.array([merges[k] for k in keys.tolist()], np.int64), "spines": spines}


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1 … of all slices, one after the other."""
    begin = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - begin, sizes)


def closed_borders(machine: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of pieces may not follow each other: a merge across the border comes before one that made a side."""
    (a_starts, a_spine), (b_starts, b_spine) = machine["spines"][1], machine["spines"][0]
    a_size, b_size = a_starts[left + 1] - a_starts[left], b_starts[right + 1] - b_starts[right]
    a = a_spine[_ragged(a_starts[left], a_size)]
    # Each of the left side's with all of the right side's.
    of_pair = np.repeat(np.arange(len(left)), a_size)
    many = b_size[of_pair]
    b = b_spine[_ragged(b_starts[right][of_pair], many)]
    a, of_pair = np.repeat(a, many, axis=0), np.repeat(of_pair, many)
    keys = a[:, 0] * BORDER + b[:, 0]
    place = np.minimum(np.searchsorted(machine["merges"], keys), len(machine["merges"]) - 1)
    hit = np.flatnonzero(machine["merges"][place] == keys)
    a, b, of_pair = a[hit], b[hit], of_pair[hit]
    when = np.maximum(np.maximum(machine["made"][place[hit]], a[:, 1]), b[:, 1])
    out = np.zeros(len(left), bool)
    out[of_pair[(when < a[:, 2]) & (when <= b[:, 2])]] = True
    return out


def border_weights(machine: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weight of each right piece after its left one, 0 or infinite; bytes and the start of a run end nothing."""
    out = np.zeros(len(left))
    if "merges" not in machine or not len(machine["merges"]):
        return out
    known = machine.setdefault("borders", np.full(BORDER_SLOTS, -1, np.int64))
    asked = np.flatnonzero((left >= 0) & (right >= 0))
    pairs = left[asked].astype(np.int64) * BORDER + right[asked]
    slots = (mixed(pairs.astype(np.uint64)) % np.uint64(len(known))).astype(np.int64)
    found = known[slots]  # a pair and, in its lowest bit, whether it is closed
    closed = (found & 1) > 0
    new = np.flatnonzero(found >> 1 != pairs)
    if len(new):
        fresh, back = np.unique(pairs[new], return_inverse=True)
        answer = closed_borders(machine, fresh // BORDER, fresh % BORDER)
        closed[new] = answer[back]
        known[slots[new]] = pairs[new] * 2 + closed[new]
    out[asked[closed]] = np.inf
    return out


def lattice(machine: dict, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arcs of the pieces composed with runs of symbols: the character each starts at, its length and piece.

    `first` gives the run of each character by the place where it ends. All places go down the trie at once.
    """
    starts, sizes, found = [], [], []
    node = machine["roots"][symbols]  # the first symbol by a table
    at = np.flatnonzero(node)
    node, length = node[at], 1
    while True:
        piece = machine["accepts"][node]
        ends = piece != NONE
        starts.append(at[ends])
        sizes.append(np.full(int(ends.sum()), length))
        found.append(piece[ends])
        inside = at + length < first[at]
        at = at[inside]
        if not len(at):
            break
        keys = node[inside] * BORDER + symbols[at + length]
        place = np.minimum(np.searchsorted(machine["keys"], keys), len(machine["keys"]) - 1)
        on = machine["keys"][place] == keys
        at, node = at[on], machine["nodes"][place[on]]
        length += 1
    single = np.zeros(len(symbols), bool)
    single[starts[0]] = True
    lone = np.flatnonzero(~single)
    return np.concatenate([lone, *starts]), np.concatenate([np.ones(len(lone), np.int64), *sizes]), np.concatenate([np.full(len(lone), BYTES, np.int32), *found])


class _Paths:
    """Shortest distances to the places of runs, and the arc that each place was reached by."""

    def __init__(self, places: int, roots: np.ndarray) -> None:
        self.distance = np.full(places, np.inf)
        self.distance[roots] = 0.0
        self.last = np.full(places, NONE, np.int32)
        self.back = np.zeros(places, np.int64)

    def relax(self, machine: dict, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> None:
        """One step of (min, +): arcs of which no two end at the same place."""
        weight = self.distance[start] + machine["weights"][piece]
        open_arcs = np.flatnonzero(weight < np.inf)
        start, end, piece = start[open_arcs], end[open_arcs], piece[open_arcs]
        weight = weight[open_arcs] + border_weights(machine, self.last[start], piece)
        better = weight < self.distance[end]
        end = end[better]
        self.distance[end], self.last[end], self.back[end] = weight[better], piece[better], start[better]


def solved(machine: dict, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids on the shortest paths over all runs of normalised characters, one after the other, and how many each has."""
    sizes = np.diff(offsets)
    run = np.repeat(np.arange(len(sizes)), sizes)
    symbols = machine["normaliser"][chars]
    start, size, piece = lattice(machine, symbols, offsets[1:][run])
    # A run of n characters has n + 1 places; arcs are dealt with by the place in the run that they start at.
    paths = _Paths(len(chars) + len(sizes), offsets[:-1] + np.arange(len(sizes)))
    place = (start - offsets[:-1][run[start]]).astype(np.int64)
    order = np.argsort(place, kind="stable")
    begin = (start + run[start])[order]
    end, piece = begin + size[order], piece[order]
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
        paths.relax(machine, begin[a:b], end[a:b], piece[a:b])

    # Back along the arcs, all runs at once.
    current, alive = offsets[1:] + np.arange(len(sizes)), np.flatnonzero(sizes > 0)
    roots = offsets[:-1] + np.arange(len(sizes))
    runs, arcs, froms = [], [], []
    while len(alive):
        at = current[alive]
        runs.append(alive)
        arcs.append(paths.last[at])
        froms.append(paths.back[at] - alive)  # the character that the arc starts at
        current[alive] = paths.back[at]
        alive = alive[current[alive] != roots[alive]]
    if not runs:
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    froms = np.concatenate(froms)
    order = np.argsort(froms)  # characters of all runs are in order
    return _spelled(machine, chars, np.concatenate(runs)[order], np.concatenate(arcs)[order], froms[order], len(sizes))


def _spelled(machine: dict, chars: np.ndarray, run: np.ndarray, arc: np.ndarray, at: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the arcs, with those of its bytes in place of a character without a piece."""
    if (arc == NONE).any():
        raise ValueError("a run without a path")
    wide = arc == BYTES
    if not wide.any():
        return arc, np.bincount(run, minlength=runs)
    odd = chars[at[wide]].astype(np.uint32)
    many = np.ones(len(arc), np.int64)
    many[wide] = 1 + (odd >= 0x80) + (odd >= 0x800) + (odd >= 0x10000)
    out = np.repeat(arc, many)
    raw = odd.astype("<u4").tobytes().decode("utf-32-le").encode()
    out[np.repeat(wide, many)] = machine["bytes"][np.frombuffer(raw, np.uint8)]
    return out, np.bincount(np.repeat(run, many), minlength=runs)


def solved_long(machine: dict, chars: np.ndarray) -> np.ndarray:
    """The same for one long run: place by place, with the weights of a window's borders looked up together."""
    n = len(chars)
    distance, last, back = [0.0] + [float("inf")] * n, [NONE] * (n + 1), [0] * (n + 1)
    symbols = machine["normaliser"][chars]
    weights = machine["weights"].tolist()
    longest = int(machine.setdefault("longest", _longest(machine)))
    arcs_in: dict[int, list[int]] = {0: [NONE]}
    for window in range(0, n, LONG_RUN * 4):
        stop = min(window + LONG_RUN * 4, n)
        reach = min(stop + longest, n)
        start, size, piece = lattice(machine, symbols[window:reach], np.full(reach - window, reach - window))
        kept = start < stop - window
        start, size, piece = (start[kept] + window).tolist(), size[kept].tolist(), piece[kept].tolist()
        out: dict[int, list[tuple[int, int]]] = {}
        for s, m, p in zip(start, size, piece, strict=True):
            out.setdefault(s, []).append((s + m, p))
            arcs_in.setdefault(s + m, []).append(p)
        pairs = list({(a, p) for s in range(window, stop) for a in arcs_in.get(s, ()) for _, p in out[s]})
        found = border_weights(machine, np.array([a for a, _ in pairs]), np.array([p for _, p in pairs]))
        border = dict(zip(pairs, found.tolist(), strict=True))
        for s in range(window, stop):
            arcs_in.pop(s, None)
            for end, p in out[s]:
                weight = distance[s] + weights[p] + border.get((last[s], p), 0.0)
                if weight < distance[end]:
                    distance[end], last[end], back[end] = weight, p, s
    arcs, froms, end = [], [], n
    while end:
        arcs.append(last[end])
        end = back[end]
        froms.append(end)
    arcs, froms = np.array(arcs[::-1], np.int32), np.array(froms[::-1])
    return _spelled(machine, chars, np.zeros(len(arcs), np.int64), arcs, froms, 1)[0]


def _longest(machine: dict) -> int:
    """Characters of the longest piece: the depth of the trie."""
    depth = np.zeros(len(machine["accepts"]), np.int64)
    order = np.argsort(machine["nodes"], kind="stable")  # a node's number is above its parent's
    for key, node in zip(machine["keys"][order].tolist(), machine["nodes"][order].tolist(), strict=True):
        depth[node] = depth[key // BORDER] + 1
    return int(depth.max())


class _Memory:
    """Ids of short runs met before, in a table of fixed size by a hash; a newer run takes the place of an older one.

    A row holds the run itself, its characters and their number, so that another run of the same hash is told apart.
    """

    CHARS, IDS = 15, 8

    def __init__(self, slots: int) -> None:
        self.runs = np.zeros((slots, self.CHARS + 1), np.uint16)
        self.ids = np.zeros((slots, self.IDS), np.uint16)
        self.many = np.zeros(slots, np.int8)

    def rows(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which runs are short enough, their rows and slots."""
        sizes = np.diff(offsets)
        wide = np.concatenate([[0], np.cumsum(chars >= 1 << 16)])
        short = np.flatnonzero((sizes <= self.CHARS) & (wide[offsets[1:]] == wide[offsets[:-1]]))
        rows = np.zeros((len(short), self.CHARS + 1), np.uint16)
        many = sizes[short]
        rows.reshape(-1)[_ragged(np.arange(len(short)) * (self.CHARS + 1), many)] = chars[_ragged(offsets[:-1][short], many)]
        rows[:, -1] = many
        hashed = np.zeros(len(short), np.uint64)
        for part in rows.view(np.uint64).T:
            hashed = mixed((hashed ^ part) + np.uint64(0x9E3779B97F4A7C15))
        return short, rows, (hashed % np.uint64(len(self.many))).astype(np.int64)

    def find(self, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return (self.runs.view(np.uint64)[slots] == rows.view(np.uint64)).all(axis=1)

    def put(self, rows: np.ndarray, slots: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        many = np.diff(ends)
        # Of two runs for one slot the last one stays.
        last = np.full(len(slots), False)
        last[len(slots) - 1 - np.unique(slots[::-1], return_index=True)[1]] = True
        kept = np.flatnonzero(last & (many <= self.IDS))
        self.runs[slots[kept]], self.many[slots[kept]] = rows[kept], many[kept]
        at = _ragged(slots[kept] * self.IDS, many[kept])
        self.ids.reshape(-1)[at] = ids[_ragged(ends[:-1][kept], many[kept])]


def normalised(machine: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the values with U+2581 for spaces and one before each value that is not empty, and where each begins."""
    text = data[offsets[0] : offsets[-1]]
    chars = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), np.uint32)
    begun = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    starts = begun[offsets - offsets[0]]
    chars = np.where(chars == 32, np.uint32(ord(SPACE)), chars)
    if machine["prefix"]:
        filled = np.diff(starts) > 0
        chars = np.insert(chars, starts[:-1][filled], ord(SPACE))
        starts = starts + np.concatenate([[0], np.cumsum(filled)])
    return chars, starts


def encoded(machine: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the values, one after the other, and where each begins."""
    chars, starts = normalised(machine, data, offsets)
    if not len(chars):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    new = np.zeros(len(chars), bool)
    new[starts[:-1][np.diff(starts) > 0]] = True
    if not machine["whole"]:
        blank = chars == ord(SPACE)
        new[1:] |= blank[1:] & ~blank[:-1]
    begin = np.append(np.flatnonzero(new), len(chars))
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin * 4), pa.py_buffer(chars)]).dictionary_encode()
    raw, ends = byte_view(runs.dictionary)
    ids, sizes = _ids_of_runs(machine, np.frombuffer(raw.tobytes(), np.uint32), ends // 4)
    kind = runs.indices.to_numpy()
    at = np.cumsum(sizes) - sizes
    every = ids[_ragged(at[kind], sizes[kind])]
    passed = np.concatenate([[0], np.cumsum(sizes[kind])])
    return every, passed[np.searchsorted(begin, starts)]


def _ids_of_runs(machine: dict, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct runs, one after the other, and how many each has: remembered or else solved."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    sizes, parts = np.zeros(n, np.int64), []  # parts: runs and their ids
    missing = np.ones(n, bool)
    memory = None
    if len(machine["raw"]) <= 1 << 16:
        memory = machine.setdefault("memory", _Memory(MEMORY_SLOTS))
        short, rows, slots = memory.rows(chars, offsets)
        hit = memory.find(rows, slots)
        known, at = short[hit], slots[hit]
        sizes[known], missing[known] = memory.many[at], False
        parts.append((known, memory.ids.reshape(-1)[_ragged(at * memory.IDS, sizes[known])].astype(np.int32)))
        row_of = np.full(n, -1)
        row_of[short] = np.arange(len(short))
    for i in np.flatnonzero(missing & (lengths > LONG_RUN)).tolist():
        ids = solved_long(machine, chars[offsets[i] : offsets[i + 1]])
        sizes[i] = len(ids)
        parts.append((np.array([i]), ids))
    todo = np.flatnonzero(missing & (lengths <= LONG_RUN))
    for a, b in pieces(np.concatenate([[0], np.cumsum(lengths[todo])]), SOLVE_CHARS, len(todo) + 1):
        some, many = todo[a:b], lengths[todo[a:b]]
        ids, counts = solved(machine, chars[_ragged(offsets[:-1][some], many)], np.concatenate([[0], np.cumsum(many)]))
        sizes[some] = counts
        parts.append((some, ids))
        if memory is not None:
            ends = np.concatenate([[0], np.cumsum(counts)])
            kept = np.flatnonzero(row_of[some] >= 0)
            picked = row_of[some[kept]]
            begin = np.concatenate([[0], np.cumsum(counts[kept])])
            memory.put(rows[picked], slots[picked], ids[_ragged(ends[:-1][kept], counts[kept])], begin)
    at = np.cumsum(sizes) - sizes
    every = np.zeros(int(sizes.sum()), np.int32)
    for some, ids in parts:
        every[_ragged(at[some], sizes[some])] = ids
    return every, sizes


def encode_text(machine: dict, text: str) -> np.ndarray:
    """Ids of the whole text; none for an empty one."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return encoded(machine, raw, np.array([0, len(raw)]))[0]


def decoded(machine: dict, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of runs of ids: bytes are joined to characters, U+2581 is a space, and the space put before is taken off."""
    spelled = machine["raw"].take(pa.array(ids))
    data, ends = byte_view(spelled)
    stops = ends[offsets]
    base, data = stops[0], data[stops[0] : stops[-1]]
    stops = stops - base
    if machine["prefix"] and len(data):
        filled = np.flatnonzero(np.diff(stops) > 0)
        first = filled[data[stops[filled]] == 32]
        data = np.delete(data, stops[first])
        gone = np.zeros(len(stops), np.int64)
        gone[first + 1] = 1
        stops = stops - np.cumsum(gone)
    raw = data.tobytes()
    try:
        raw.decode()
        # Texts end between characters if none begins with a byte inside one.
        inside = (data[np.minimum(stops[:-1], max(len(data) - 1, 0))] & 0xC0 == 0x80) & (np.diff(stops) > 0) if len(data) else np.zeros(1, bool)
        if not inside.any():
            return pa.Array.from_buffers(pa.large_string(), len(stops) - 1, [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())
    except UnicodeDecodeError:
        pass
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], pa.string())


def decode_ids(machine: dict, ids: list[int]) -> str:
    return decoded(machine, np.array(ids, np.int32), np.array([0, len(ids)]))[0].as_py()


def _sent(df: DataFrame, model_path: str):
    """The machines, compiled once: a fixed size, whatever the table's."""
    return df.sparkSession.sparkContext.broadcast(compiled(Path(model_path).read_bytes()))


def encode(df: DataFrame, model_path: str, *, text: str = "text", ids: str = "token_ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with a last column `ids`: array<int> of the whole text. A null or empty text has no ids.

    The same text always has the same ids, so repeated rows agree; a column of that name, in any case, is replaced,
    columns in `drop` are left out, others stay. A text is in memory with its ids; what a worker remembers of runs and
    borders has a fixed size. The machines travel in the job.
    """
    at = df.columns.index(text)
    stay = [i for i, c in enumerate(df.columns) if c not in drop and c.lower() != ids.lower()]
    sent = _sent(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            for start, end in pieces(byte_view(batch.column(at))[1], BLOCK_BYTES, BLOCK_ROWS):
                rows = batch.slice(start, end - start)
                found, ends = encoded(machine, *byte_view(rows.column(at)))
                values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found, pa.int32()))
                columns = [*(rows.column(i) for i in stay), values]
                yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return mapped(df, run, [*kinds(df, stay), (ids, "array<int>")])


def decode(df: DataFrame, model_path: str, *, ids: str = "token_ids", text: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with a last column `text`: the text of `ids`. No ids, or null, give an empty text."""
    at = df.columns.index(ids)
    stay = [i for i, c in enumerate(df.columns) if c not in drop and c.lower() != text.lower()]
    sent = _sent(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            column = batch.column(at)
            sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            for start, end in pieces(np.concatenate([[0], np.cumsum(sizes)]), BLOCK_BYTES // 4, BLOCK_ROWS):
                rows = batch.slice(start, end - start)
                flat = rows.column(at).flatten().to_numpy(zero_copy_only=False)
                texts = decoded(machine, flat, np.concatenate([[0], np.cumsum(sizes[start:end])]))
                columns = [*(rows.column(i) for i in stay), texts]
                yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return mapped(df, run, [*kinds(df, stay), (text, "string")])
