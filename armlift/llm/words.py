"""Words of whole Arrow batches as numpy arrays: places, 64-bit hashes, window hashes.

Words are the runs of bytes other than space and 0x09-0x0D. UTF-8 keeps those bytes for these characters alone, so the
work is done on bytes, many documents at a time, without one Python object per word.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 19  # bytes hashed at a time
_MULTIPLIER = 0x9E3779B97F4A7C15
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values with well spread bits."""
    h = h ^ np.uint64(salt * _MULTIPLIER % (1 << 64))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(33))


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Words:
    """``start``/``end``: byte places of words in ``data``; words ``first[i]:first[i + 1]`` belong to row i."""

    def __init__(self, column, lower: bool = True):
        import pyarrow as pa

        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        _, bounds, data = column.buffers()
        self.bounds = np.zeros(1, np.int64)
        if len(column):
            self.bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
        lo, hi = int(self.bounds[0]), int(self.bounds[-1])
        self.bounds = self.bounds - lo
        raw = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
        self.data = lower_table()[raw] if lower else raw
        word = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.bounds] = True
        starts, ends = word.copy(), word.copy()
        starts[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.bounds)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, in pieces cut between words."""
        out = np.zeros(len(self.start), np.uint64)
        length = self.end - self.start
        if not len(out):
            return out
        power = np.cumprod(np.full(int(length.max()), _MULTIPLIER, np.uint64))
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + PIECE, side="right")))
            n = length[a:b]
            heads = np.cumsum(n) - n
            inside = np.arange(int(n.sum())) - np.repeat(heads, n)
            values = (self.data[inside + np.repeat(self.start[a:b], n)].astype(np.uint64) + np.uint64(1)) * power[inside]
            out[a:b] = np.add.reduceat(values, heads)
            a = b
        return mix(out ^ length.astype(np.uint64))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; run i starts at word i."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(_MULTIPLIER) + h[k : k + n]
    return mix(total)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a document's shingles; fewer words than ``width`` make one shingle, none makes none."""
    if 0 < len(h) < width:
        return mix(windows(h, len(h)), len(h))
    return np.unique(windows(h, width))
