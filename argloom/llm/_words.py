"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D.  None of these
bytes occurs inside a multi-byte UTF-8 sequence, so working on bytes gives the
same words as working on code points.  All functions are pure numpy helpers for
use inside ``mapInArrow`` / ``applyInArrow``; they see one bounded chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one call of the numpy helpers sees at most (one longer text goes alone).
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, so that every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        m = max(n, 2 * len(_powers), 1024)
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, _BASE)]))
    return _powers


class Chunk:
    """The words of some consecutive texts: ``starts``/``ends`` into ``data``, and ``first`` (of each text, the first word's index; one more entry at the end)."""

    def __init__(self, rows: slice, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.rows = rows
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = _WORD[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lens = self.ends - self.starts
        at = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
        own = self.data[pos + np.repeat(self.starts, lens)]
        return mix(np.add.reduceat(_BYTE[own] * _power(int(lens.max()))[pos], at))

    def shingles(self, k: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each text's ``k``-word windows, and where each text's windows start (one more entry at the end)."""
        w = self.word_hashes() if words is None else words
        count = np.maximum(np.diff(self.first) - (k - 1), 0)
        at = np.concatenate([[0], np.cumsum(count)])
        return window_hashes(w, k)[ranges(self.first[:-1], count)], at


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """The hash of ``w[i:i+k]`` at each i; windows are taken regardless of text borders."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, _MULT[0])
    for j in range(k):
        h = h + w[j : j + n] * _MULT[(j + 1) % 64]
    return mix(h)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of all ranges ``starts[i] .. starts[i] + counts[i] - 1``, one after the other."""
    counts = np.asarray(counts, dtype=np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(at, counts) + np.repeat(np.asarray(starts, dtype=np.int64), counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into chunks of at most ``limit`` bytes (one longer text goes alone)."""
    data, at = text_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield Chunk(slice(i, j), data[at[i] : at[j]], at[i : j + 1] - at[i], lower)
        i = j
