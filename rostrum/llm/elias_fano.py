"""Elias-Fano sequences over numpy arrays, and levels kept in a memory-mapped file."""

from __future__ import annotations

import tempfile

import numpy as np

U64 = np.uint64
_POP = np.array([bin(b).count("1") for b in range(256)], np.int64)
_PLACE = np.zeros((256, 8), np.int64)  # place of the r-th set bit of a byte
for _b in range(256):
    for _r, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _PLACE[_b, _r] = _i


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, one after the other, and 8 bytes to read beyond the end."""
    parts = []
    for at in range(0, len(values), 1 << 16):
        part = np.ascontiguousarray(values[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little", count=width) if width else np.empty((len(part), 0), np.uint8)
        parts.append(np.packbits(bits.ravel(), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


class EliasFano:
    """A monotone sequence in about 2 + log2(universe / n) bits a value, with vectorised access and search.

    Values' low bits are packed; their high parts are a unary bit vector whose zeros are counted per 64 bits.
    """

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.width = max(0, min(56, (max(universe, 1) // max(self.n, 1)).bit_length() - 1))
        values = np.asarray(values, U64)
        self.low = _packed(values, self.width)
        high = (values >> U64(self.width)).astype(np.int64)
        self.buckets = (max(universe, 1) >> self.width) + 1
        size = -(-(self.n + self.buckets + 1) // 64) * 64
        bits = np.zeros(size, bool)
        bits[high + np.arange(self.n)] = True
        self.high = np.packbits(bits, bitorder="little").view("<u8")
        zeros = 64 - _POP[self.high.view(np.uint8)].reshape(-1, 8).sum(1)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)]).astype(np.int64)

    def levels(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]

    def attach(self, levels: list[np.ndarray]) -> None:
        self.low, self.high, self.zeros = levels

    def _lows(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.width
        window = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return (window[bit >> 3] >> (bit & 7).astype(U64)) & U64((1 << self.width) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left, rest = ~self.high[word], k - self.zeros[word]
        out, open_ = np.zeros(len(k), np.int64), np.ones(len(k), bool)
        for j in range(8):
            byte = ((left >> U64(8 * j)) & U64(255)).astype(np.int64)
            here = open_ & (rest < _POP[byte])
            out[here] = word[here] * 64 + 8 * j + _PLACE[byte[here], rest[here]]
            open_ &= ~here
            rest = np.where(open_, rest - _POP[byte], rest)
        return out

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the index of the first element not below it in its bucket, and whether it is equal."""
        wanted = np.asarray(wanted, U64)
        bucket, low = (wanted >> U64(self.width)).astype(np.int64), wanted & U64((1 << self.width) - 1)
        inside = bucket < self.buckets
        bucket = np.where(inside, bucket, 0)
        end = self._zero(bucket) - bucket
        start = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) - bucket + 1, 0)
        end, start = np.where(inside, end, 0), np.where(inside, start, 0)
        first, last = start, end
        if self.n == 0:
            return first, np.zeros(len(wanted), bool)
        while (first < last).any():
            middle = (first + last) >> 1
            below = (first < last) & (self._lows(np.minimum(middle, self.n - 1)) < low)
            first, last = np.where(below, middle + 1, first), np.where(below | (first >= last), last, middle)
        found = first < end
        found[found] = self._lows(first[found]) == low[found]
        return first, found

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        at = np.arange(self.n)
        return ((ones - at).astype(U64) << U64(self.width)) | self._lows(at)


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in a memory-mapped temporary file without a name: it goes when they do."""
    file, out, at = tempfile.TemporaryFile(), [], 0
    for a in arrays:
        file.write(a.tobytes())
        pad = -a.nbytes % 8
        file.write(b"\0" * pad)
    file.write(b"\0" * 8)
    file.flush()
    whole = np.memmap(file, np.uint8, "r")
    for a in arrays:
        out.append(whole[at : at + a.nbytes].view(a.dtype))
        at += a.nbytes + (-a.nbytes % 8)
    file.close()
    return out
