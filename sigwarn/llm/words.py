"""Vectorised work on Arrow string columns: words, word hashes and n-gram hashes of many documents at once.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after lower-casing A-Z. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together, so that the temporary arrays stay small.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            full = np.full(n, base, dtype=np.uint64)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0][:n], _POWERS[1][:n]


def byte_blocks(column: pa.Array, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of its rows in them) for consecutive runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """The words of a block: hash, document (row in the block), byte range and shape of each, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.n_docs, low = len(offsets) - 1, _LOWER[data]
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low] * power[:-1], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.bounds))
        high = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(data >= 128, out=high[1:])
        stop = low[self.end - 1] if len(self.end) else np.zeros(0, np.uint8)
        #: 0 to 7: whether it is longer than 8 bytes, ends in punctuation, has bytes beyond ASCII.
        self.shape = ((self.end - self.start > 8) + 2 * ~(((stop >= 97) & (stop <= 122)) | ((stop >= 48) & (stop <= 57)) | (stop >= 128)) + 4 * (high[self.end] > high[self.start])).astype(np.int64)


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """For each document, the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence."""
    h, count = words.hash, len(words.hash)
    odd = np.uint64(0xD6E8FEB86659FD93)
    grams = h[: max(0, count - n + 1)].copy()
    for k in range(1, n):
        grams = mix(grams * odd + h[k : count - n + 1 + k]) if len(grams) else grams
    for i in range(words.n_docs):
        a, b = int(words.bounds[i]), int(words.bounds[i + 1])
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            whole = h[a : a + 1] + np.uint64(b - a)
            for k in range(a + 1, b):
                whole = mix(whole * odd + h[k : k + 1])
            yield whole
        else:
            yield np.zeros(0, dtype=np.uint64)
