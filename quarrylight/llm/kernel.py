"""Vectorised text kernel shared by the corpus operators.

Arrow string columns are read as one flat byte array plus offsets, so splitting, hashing and windowing cost a few
numpy passes per byte instead of a Python object per word. Work goes block by block (about a megabyte of text, whole
documents), which bounds the memory of a Python worker whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20

#: The bytes 0x20 and 0x09-0x0D separate words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over 64-bit lanes."""
    x = x ^ (x >> np.uint64(33))
    x *= _C3
    x ^= x >> np.uint64(29)
    x *= _C2
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two hash arrays."""
    x = a * _C1
    x += b
    x ^= x >> np.uint64(29)
    x *= _C2
    x ^= x >> np.uint64(32)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and the n+1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last row, bytes, offsets) of runs of whole rows; a run passes `size` only if it is one row."""
    flat, at = column_bytes(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, flat[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """Words of a block: byte `start` and `end` of each, and `first[r]:first[r+1]`, the words of row r."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES):
        self.flat, self.at = flat, at
        gap = separators[flat]
        before, after = np.empty(len(flat), bool), np.empty(len(flat), bool)
        if len(flat):
            before[0], before[1:] = True, gap[:-1]
            after[-1], after[:-1] = True, gap[1:]
            before[at[:-1][at[:-1] < len(flat)]] = True
            after[at[1:][at[1:] > 0] - 1] = True
        self.gap = gap
        self.start = np.flatnonzero(before & ~gap)
        self.end = np.flatnonzero(after & ~gap) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def row(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every block."""
        padded = np.zeros(len(self.flat) + 8, np.uint8)
        padded[: len(self.flat)] = self.flat
        eight = np.ndarray((len(self.flat) + 1,), "<u8", buffer=padded, strides=(1,))
        size = self.end - self.start
        h = size.astype(np.uint64) * _C1
        which, left = np.arange(len(size)), size
        for j in range(0, _LONG_WORD, 8):
            if j:
                keep = left > 8
                which, left = which[keep], left[keep] - 8
            if not len(which):
                break
            piece = eight[self.start[which] + j] & _MASKS[np.minimum(left, 8)]
            h[which] = mix(h[which] ^ piece) + _C1
        for w in np.flatnonzero(size > _LONG_WORD):
            h[w] = xxhash.xxh3_64_intdigest(self.flat[self.start[w] : self.end[w]].tobytes())
        return h

    def fits(self, k: int) -> np.ndarray:
        """Whether k words of one row start at each word."""
        if not len(self.start):
            return np.zeros(0, bool)
        return np.arange(len(self.start)) + k <= np.repeat(self.first[1:], self.count)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from each place on, by doubling; of length len(h)-k+1 (or 0)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, taken, power, width = None, 0, h, 1
    while True:
        if k & width:
            part = power[taken:]
            out = part.copy() if out is None else pair(out[: len(part)], part[: len(out)])
            taken += width
        width *= 2
        if width > k:
            return out[:n]
        power = pair(power[: len(power) - width // 2], power[width // 2 :])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w entries from each place on; of length len(x)-w+1 (or 0)."""
    if len(x) < w:
        return x[:0]
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true entries."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places some [start, end) covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
