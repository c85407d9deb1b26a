"""Vectorised text kernels on Arrow buffers, used inside ``mapInArrow`` functions.

All of them work on the UTF-8 bytes of a slice of rows at a time, so memory is
bounded by ``SLICE_BYTES`` (or by the longest single text) and no Python object
is made per word.  A word is a maximal run of characters other than space and
U+0009 to U+000D; every such separator is one byte in UTF-8.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_WORDY = np.ones(256, bool)
_WORDY[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multipliers of the polynomial hashes, one pair for each of two independent functions.
_BYTE_MUL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD_MUL = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(mul: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``mul`` and of its inverse modulo 2**64."""
    got = _tables.get(mul)
    if got is None or len(got[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        tables = []
        for base in (mul, pow(mul, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table))
        got = _tables[mul] = (tables[0], tables[1])
    return got[0][:n], got[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def release() -> None:
    """Give back to the system what earlier tasks of this worker have freed; workers are used again and again."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's alone
    if trim:
        trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and a ``release`` once it has ended: its worker waits for the next task beside stages that have none for it."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return freed


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of ``rows`` rows at most whose texts have ``limit`` bytes at most, or one row."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n, start + (rows or n))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return data, offsets - first


class Words:
    """The words of some texts: byte bounds, and ``row[i]:row[i+1]`` are those of text ``i``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, offsets = utf8(texts)
        self.data = data = _LOWER[data] if lower else data
        self.offsets = offsets
        wordy = _WORDY[data]
        first, last = wordy.copy(), wordy.copy()
        first[1:] &= ~wordy[:-1]
        last[:-1] &= ~wordy[1:]
        filled = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        first[heads] = wordy[heads]
        last[tails] = wordy[tails]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def hashes(self, function: int = 0) -> np.ndarray:
        """A 64-bit hash for each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        power, inverse = _powers(_BYTE_MUL[function], len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(_WORD_MUL[function]))

    def prefix_sums(self, h: np.ndarray, function: int = 0) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = _powers(_WORD_MUL[function], len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[: len(h)], out=total[1:])
        return total, inverse

    def windows(self, h: np.ndarray, width: int, function: int = 0) -> np.ndarray:
        """A hash for each ``width`` consecutive word hashes of the slice; those across texts are not meant."""
        if len(h) < width:
            return np.zeros(0, np.uint64)
        total, inverse = self.prefix_sums(h, function)
        return mix((total[width:] - total[:-width]) * inverse[: len(h) - width + 1] + np.uint64(width))

    def whole(self, h: np.ndarray, function: int = 0) -> np.ndarray:
        """A hash of the whole word sequence of each text."""
        total, inverse = self.prefix_sums(h, function)
        n = self.counts().astype(np.uint64)
        return mix((total[self.row[1:]] - total[self.row[:-1]]) * inverse[self.row[:-1]] + n)


def inside(row: np.ndarray, width: int) -> np.ndarray:
    """For each word of a slice: whether ``width`` words of the same text begin there."""
    n = int(row[-1])
    left = np.repeat(row[1:], np.diff(row)) - np.arange(n)
    return left >= width


def joined(words: Words, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts' kept words, joined by one space."""
    n, row = len(words), words.row
    kept = np.ones(n, bool) if kept is None else kept
    size = len(words.data)
    edge = np.zeros(size + 1, np.int8)
    edge[words.starts[kept]] += 1
    edge[words.ends[kept]] -= 1
    take = np.cumsum(edge[:size], dtype=np.int8).astype(bool)
    which = np.flatnonzero(kept)
    text = np.repeat(np.arange(len(row) - 1), np.diff(row))[which]
    gap = words.ends[which[:-1][text[1:] == text[:-1]]]
    take[gap] = True
    out = words.data.copy()
    out[gap] = 0x20
    before = np.zeros(size + 1, np.int64)
    np.cumsum(take, out=before[1:])
    return out[take], before[words.offsets]


def argmin_windows(values: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive values, where the leftmost least one is."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(values))
    span = 1
    while span * 2 <= width:
        left, right = at[:-span], at[span:]
        at = np.where(values[right] < values[left], right, left)
        span *= 2
    left, right = at[:n], at[width - span : width - span + n]
    return np.where(values[right] < values[left], right, left)
