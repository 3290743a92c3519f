"""Elias-Fano coding of non-decreasing integers with a select structure, in numpy.

A value's low ``l`` bits lie packed; its high part is a 1 at position (value >> l) + index of a bit vector. Every
256th 1 has its position sampled in 32 bits, so ``select`` looks at one short run of bytes.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEAD = "<QQBxxxII"  # count, first value, low bits, bytes of low part, bytes of high part


class EliasFano:
    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        base = int(values[0])
        v = (np.asarray(values, np.int64) - base).astype(np.uint64)
        bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        steps = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> steps) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, base, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        places = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bit = (self.low[places >> 3] >> (places & 7).astype(np.uint8)) & 1
        return (bit.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and the bytes that follow."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        stop = int(self.samples[i // SAMPLE + 1]) + 1 if i // SAMPLE + 1 < len(self.samples) else None
        window = self.high[start >> 3 : None if stop is None else (stop + 7) >> 3]
        ones = np.flatnonzero(np.unpackbits(window, bitorder="little")) + (start & ~7)
        place = int(ones[ones >= start][i % SAMPLE])
        return self.base + ((place - i) << self.low_bits) + int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        index = np.arange(self.n)
        return self.base + ((ones - index).astype(np.int64) << self.low_bits) + self._low(index)

    def to_bytes(self) -> bytes:
        head = struct.pack(HEAD, self.n, self.base & (1 << 64) - 1, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The coded list at the start of ``data`` and its length in bytes."""
        n, base, bits, n_low, n_high = struct.unpack_from(HEAD, data)
        base -= (base >> 63) << 64
        at = struct.calcsize(HEAD)
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        n_samples = -(-n // SAMPLE)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        return cls(n, base, bits, low, high, samples), at + n_low + n_high + 4 * n_samples
