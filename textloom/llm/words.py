"""Words, word hashes and n-gram hashes of Arrow text columns, in numpy.

A word is a run of bytes outside a set of ASCII separators, so word borders can
be found on the UTF-8 buffer of a column without decoding it.  Hashes are 64
bits; arithmetic wraps on purpose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes between words: blanks and control blanks, or all ASCII but letters and digits.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
UPPER = bytes(range(0x41, 0x5B))

_SLICE = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1024), _powers(pow(_BASE, -1, 2**64), 1024)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; a null row is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def bounds(body: np.ndarray, at: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; a word never crosses a row."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    word = inside[body]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    filled = np.diff(at) > 0
    heads, tails = at[:-1][filled], at[1:][filled] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A hash of each byte span, from running sums over slices of bounded size."""
    table, out = (_FOLD if fold else _BYTE), np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _SLICE, side="right")))
        size = int(ends[j - 1]) - base
        up, down = _tables(size + 1)
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[body[base : base + size]] * up[:size], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if size > len(_UP):
        grown = max(size, _SLICE + 1)
        up, down = _powers(_BASE, grown), _powers(pow(_BASE, -1, 2**64), grown)
        if grown > 4 * _SLICE:
            return up, down  # for one very long word; not kept
        _UP, _DOWN = up, down
    return _UP, _DOWN


class Words:
    """Word hashes of a text column: ``h``, with the words of row r at ``first[r]:first[r + 1]``."""

    def __init__(self, column: pa.Array, separators: bytes = BLANKS, fold: bool = False):
        self.body, self.at = buffers(column)
        self.starts, self.ends = bounds(self.body, self.at, separators)
        self.h = word_hashes(self.body, self.starts, self.ends, fold)
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each word (the last n - 1 starts are left out)."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = out * _GRAM + h[j : j + m]
    return mix(out)


def whole(h: np.ndarray) -> int:
    """Hash of a whole word sequence, apart from all n-gram hashes of other lengths."""
    return int(grams(h, len(h))[0])
