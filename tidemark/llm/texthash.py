"""Hashes of words and of word shingles, for whole Arrow batches at a time.

A word's hash is a polynomial over its bytes modulo 2**64, read off two running sums, then mixed;
no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import STEP_BYTES

_rng = np.random.default_rng(20240607)
#: A random odd number for each byte, one odd base and its inverse modulo 2**64.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
SHINGLE_FACTORS = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWERED_VALUE = BYTE_VALUE[LOWER]

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, STEP_BYTES + 4096), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of ``x`` spread over all 64 (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, off: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of every run of non-space bytes; a run ends with its text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~spaces[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = LOWERED_VALUE) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans ascend and may be prefixes of words."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, a + STEP_BYTES)))
        b = int(end[i:j].max())
        n = b - a
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value[data[a:b]] * _power(BASE, n)[:n], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * _power(INVERSE, n)[s]
        i = j
    return mix(out)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and the n + 1 offsets of the texts among them."""
    start, end = word_spans(data, off)
    return span_hashes(data, start, end), np.searchsorted(start, off)


def shingles(word: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and the offsets of the texts among them.

    A text of 1 to k - 1 words has its whole sequence as its one shingle; a text without words has none.
    """
    count = np.diff(at)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(at[:-1] - out_at[:-1], made) + np.arange(out_at[-1])
    last = np.repeat(at[1:], made)
    total = np.zeros(len(first), np.uint64)
    for j in range(k):
        place = first + j
        there = place < last
        total += np.where(there, word[np.minimum(place, max(len(word) - 1, 0))] if len(word) else 0, np.uint64(j + 1)) * SHINGLE_FACTORS[j]
    return mix(total), out_at
