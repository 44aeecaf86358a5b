"""Words and their hashes for many texts at once, straight from the bytes of a column.

A word is a run of ASCII letters, digits and bytes from 0x80; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

#: Bytes that are taken at once; a longer run without a separator is taken whole.
BLOCK = 1 << 20

#: Each byte as it counts; 0 between words.
FOLDED = np.array(
    [b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8
)
IN_WORDS = (FOLDED != 0).astype(np.uint8)
#: The same with runs of printable marks as words of their own kind.
MARKED = np.where((FOLDED == 0) & (np.arange(256) > 32) & (np.arange(256) < 127), np.arange(256), FOLDED).astype(np.uint8)
WORDS_AND_MARKS = np.where(FOLDED != 0, 1, 2 * (MARKED != 0)).astype(np.uint8)

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_BYTE[0] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**64, 64, dtype=np.uint64, endpoint=False) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x, which is overwritten."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _STEP)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def word_hashes(data: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the values, in order, and how many words each value has.

    With `marks`, runs of punctuation count as words too.
    """
    fold, kinds = (MARKED, WORDS_AND_MARKS) if marks else (FOLDED, IN_WORDS)
    at, end, starts, hashes = int(offsets[0]), int(offsets[-1]), [], []
    while at < end:
        stop = min(at + BLOCK, end)
        if stop < end:  # end with a separator, or else with the word
            cut = np.flatnonzero(fold[data[at:stop]] == 0)
            if len(cut):
                stop = at + int(cut[-1]) + 1
            else:
                while stop < end and fold[data[stop]]:
                    stop += 1
        folded, kind = fold[data[at:stop]], kinds[data[at:stop]]
        before = np.empty_like(kind)
        before[:1] = 0
        before[1:] = kind[:-1]
        begin = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        before[begin] = 0  # words end with their text
        first = np.flatnonzero((kind != 0) & (kind != before))
        if len(first):
            lengths = np.diff(np.append(first, len(folded)))
            place = np.arange(first[0], len(folded)) - np.repeat(first, lengths)
            values = _BYTE[folded[first[0] :]]
            values *= _powers(int(place.max()) + 1)[place]
            hashes.append(mixed(np.add.reduceat(values, first - first[0])))
            starts.append(first + at)
        at = stop
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def runs(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` consecutive words and the value each is of; fewer words make one run of all."""
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), many)
    start = (np.cumsum(counts) - counts)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    total = np.minimum(counts, size).astype(np.uint64)[owner] * _PLACE[-1]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    some_short = bool((counts < size).any())
    for k in range(size):
        part = padded[start + k] * _PLACE[k]
        if some_short:
            part[counts[owner] <= k] = 0
        total += part
    return mixed(total), owner
