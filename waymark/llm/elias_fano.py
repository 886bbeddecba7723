"""Elias-Fano coding of a non-decreasing sequence, with constant-time-like selection.

`n` values up to `u` take about 2 + log2(u / n) bits each: the low bits lie side by side, the
high bits are a unary bit vector in which value i is the i-th one. Every `SAMPLE`-th one's
place is kept, so selecting a value scans a few words of that vector and no table of values.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 64
# Place of the k-th one of every byte.
_IN_BYTE = np.zeros((256, 8), dtype=np.int64)
for _byte in range(256):
    _places = [bit for bit in range(8) if _byte >> bit & 1]
    _IN_BYTE[_byte, : len(_places)] = _places
_HEAD = np.dtype([("count", "<u8"), ("top", "<u8"), ("low", "<u4"), ("high_bytes", "<u4")])


class EliasFano:
    def __init__(self, count: int, top: int, low: int, lows: np.ndarray, highs: np.ndarray) -> None:
        """`lows`, `highs`: bytes of the packed low bits and the unary bit vector."""
        self.count, self.top, self.low = count, top, low
        self._lows, self._highs = lows, highs
        ones = np.bitwise_count(highs).cumsum() if len(highs) else np.zeros(0, int)
        wanted = np.arange(0, count, SAMPLE)
        self._sampled = np.searchsorted(ones, wanted, side="right")  # byte of every SAMPLE-th one
        self._before = np.concatenate([[0], ones])[self._sampled]

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        count = len(values)
        low = max(0, (top // count).bit_length() - 1) if count else 0
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        unary = np.zeros(count + (top >> low) + 1 if count else 0, dtype=np.uint8)
        unary[(values >> np.uint64(low)).astype(np.int64) + np.arange(count)] = 1
        return cls(count, top, low, lows, np.packbits(unary, bitorder="little"))

    def to_bytes(self) -> bytes:
        head = np.array([(self.count, self.top, self.low, len(self._highs))], dtype=_HEAD)
        return head.tobytes() + self._lows.tobytes() + self._highs.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple["EliasFano", int]:
        """The sequence at the start of `raw`, and how many bytes it takes."""
        head = np.frombuffer(raw, dtype=_HEAD, count=1)[0]
        count, top, low, wide = (int(x) for x in head)
        at, narrow = _HEAD.itemsize, (count * low + 7) // 8
        lows = np.frombuffer(raw, dtype=np.uint8, offset=at, count=narrow)
        highs = np.frombuffer(raw, dtype=np.uint8, offset=at + narrow, count=wide)
        return cls(count, top, low, lows, highs), at + narrow + wide

    def _low_bits(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        padded = np.concatenate([self._lows, np.zeros(8, dtype=np.uint8)])
        window = np.zeros(len(i), dtype=np.uint64)
        for k in range((self.low + 14) // 8):
            window |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        return ((window >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def select(self, i: np.ndarray | int) -> np.ndarray | int:
        """The i-th value, or those of an array of places: from the sample before each, byte by byte."""
        places = np.atleast_1d(np.asarray(i, dtype=np.int64))
        if len(places) and not (0 <= places.min() and places.max() < self.count):
            raise IndexError(i)
        at, seen = self._sampled[places // SAMPLE].copy(), self._before[places // SAMPLE].astype(np.int64)
        open_ = np.arange(len(places))
        while len(open_):
            here = np.bitwise_count(self._highs[at[open_]]).astype(np.int64)
            before = seen[open_] + here <= places[open_]
            open_, here = open_[before], here[before]
            seen[open_] += here
            at[open_] += 1
        one = at * 8 + _IN_BYTE[self._highs[at], places - seen]
        found = (one - places << self.low) | self._low_bits(places)
        return found if np.ndim(i) else int(found[0])
