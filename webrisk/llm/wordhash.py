"""Words of Arrow text columns as 64-bit hashes, computed for a whole batch with numpy.

A word's hash is a polynomial over its UTF-8 bytes, taken from running sums, so it costs a few operations per
byte and no Python object per word. Buffers are hashed in slices of SLICE bytes cut between words, so the
working memory doesn't depend on how long one text is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
_SEEDS = np.random.default_rng(20240229)
_BYTE = _SEEDS.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of words between white space, and of words of ASCII letters, digits and anything beyond ASCII.
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[0]


@dataclass
class Words:
    """Words of a batch: hash, byte range in `data`, and per row the index of its first word."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # row of each word
    first: np.ndarray  # length rows + 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(column: pa.Array, letters: np.ndarray = NOT_WHITE, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = letters[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    before[:1] = False
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    after[-1:] = False
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + SLICE, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        up, down = _powers(max(b - a, SLICE))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * up[:b - a], out=sums[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        hashes[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, hashes, start, end, row, np.searchsorted(start, offsets))


def chained(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of `width` consecutive words from each start; its length is len(hashes) - width + 1, or 0."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width + 1 + seed * 0x51ED2701, np.uint64)
    factor = np.uint64(_BASE)
    for i in range(width):
        out = mix(out * factor + hashes[i:i + n]) if i % 2 else out * factor + hashes[i:i + n]
    return mix(out)
