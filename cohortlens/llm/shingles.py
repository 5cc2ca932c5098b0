"""Word-shingle multisets of whole texts, as 64-bit hashes, for Arrow batches.

A word is a maximal run of bytes that are not ASCII or are ASCII letters or
digits, A-Z lower-cased; a shingle is ``size`` consecutive words (a text of
fewer words, but not none, is one shingle).  All texts of a batch are hashed
together with array arithmetic; no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cohortlens.llm.arrays import text_bytes

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEPS = tuple(U(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                                 0xE7037ED1A0B428DB, 0x589965CC75374CC3))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _letters() -> np.ndarray:
    kept = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 0x80 or chr(b).isalnum():
            kept[b] = b + 32 if 65 <= b <= 90 else b
    return kept


LETTERS = _letters()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def word_spans(texts: pa.Array):
    """(row, begin, size) of every word of the batch, in order, and a function
    that hashes spans of its bytes, given as (begin, end)."""
    raw, ends = text_bytes(texts)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none, lambda begin, end: np.zeros(len(begin), U)
    letters = LETTERS[raw]
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = letters > 0
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    limits = ends[:-1][ends[:-1] < len(raw)]   # where another text begins
    first[limits] = inside[limits]
    last = inside[:-1] & ~inside[1:]
    last[limits[limits > 0] - 1] = inside[limits[limits > 0] - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(letters * up[:len(raw)], out=total[1:])
    row = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(start, ends), prepend=0))
    return row, start, stop - start, lambda begin, end: (total[end] - total[begin]) * down[begin]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of the batch, in order."""
    row, begin, size, spans = word_spans(texts)
    return row, mix(spans(begin, begin + size) + BASE * size.astype(U))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle occurrence, in order."""
    row, word = words(texts)
    n = np.bincount(row, minlength=len(texts))
    long_row, long_word = row, word
    if len(word) >= size:
        inside = row[size - 1:] == row[:len(row) - size + 1]
        total = np.zeros(len(word) - size + 1, U)
        for j in range(size):
            total += word[j:len(word) - size + 1 + j] * STEPS[j % len(STEPS)] * U(2 * j + 1)
        long_row, long_word = row[:len(row) - size + 1][inside], mix(total)[inside]
    else:
        long_row, long_word = row[:0], word[:0]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        begin = np.cumsum(n) - n
        total = np.zeros(len(short), U)
        for j in range(size - 1):
            has = n[short] > j
            total[has] += word[begin[short][has] + j] * STEPS[j % len(STEPS)] * U(2 * j + 1)
        long_row = np.concatenate([long_row, short])
        long_word = np.concatenate([long_word, mix(total + n[short].astype(U))])
    return long_row, long_word


def multisets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, times it occurs), ordered by row and hash."""
    row, value = shingles(texts, size)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))
