"""Elias-Fano coding of ascending integers: low bits packed, high bits in unary, with sampled select."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

#: Every so many-th one's place in the unary bits is kept, relative and in 32 bits.
SAMPLE = 256
_HEAD = struct.Struct("<QBQ")


class EliasFano:
    """Ascending integers, repeats allowed, from 0 below 2**63, in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        if len(v) and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("values must ascend from 0")
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        u = v.astype(np.uint64)
        low = np.packbits((u[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (u >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        need, byte = i % SAMPLE, place // 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            bits[: max(0, place - byte * 8)] = 0
            ones = np.flatnonzero(bits)
            if need < len(ones):
                high = byte * 8 + int(ones[need]) - i
                break
            need, byte = need - len(ones), byte + 64
            place = byte * 8
        start = i * self.low_bits
        part = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8].tobytes(), "little") >> start % 8
        return high << self.low_bits | part & (1 << self.low_bits) - 1

    def _lows(self, i: int, j: int) -> np.ndarray:
        """The low bits of the values from i to j."""
        if not self.low_bits:
            return np.zeros(j - i, np.uint64)
        a, b = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].reshape(j - i, self.low_bits).astype(np.uint64)
        return (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def runs(self) -> Iterator[np.ndarray]:
        """All values in order, SAMPLE at a time: each run is selected by its sample's place in the unary bits, and no more than a run is expanded."""
        for i in range(0, self.n, SAMPLE):
            j = min(self.n, i + SAMPLE)
            a = int(self.samples[i // SAMPLE])
            b = int(self.samples[j // SAMPLE]) if j < self.n else 8 * len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[a // 8 : (b + 7) // 8], bitorder="little")) + a // 8 * 8
            ones = ones[ones >= a][: j - i]
            high = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
            yield (high | self._lows(i, j)).astype(np.int64)

    def values(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits).astype(np.uint64)
        return (high | (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.low_bits, len(self.high)) + self.samples.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, size = _HEAD.unpack_from(data)
        a = _HEAD.size
        b = a + 4 * (-(-n // SAMPLE))
        c = b + size
        part = lambda x, y, t: np.frombuffer(data[x:y], t)
        return cls(n, bits, part(c, c + (n * bits + 7) // 8, np.uint8), part(b, c, np.uint8), part(a, b, "<u4"))
