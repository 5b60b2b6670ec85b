"""Wavelet matrix over numpy: bit-planes of a sequence of ids with rank and select."""

from __future__ import annotations

import numpy as np

#: Bits between two entries of a plane's rank directory.
BLOCK = 512


class WaveletMatrix:
    """Plane l holds bit levels - 1 - l of each value, in the order that the planes before it left: zeros first, stable."""

    def __init__(self, n: int, levels: int, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.levels, self.zeros, self.planes, self.ranks = n, levels, zeros, planes, ranks

    @staticmethod
    def shape(n: int) -> tuple[int, int]:
        """Bytes and directory entries of a plane."""
        blocks = n // BLOCK + 1
        return blocks * BLOCK // 8, blocks

    @classmethod
    def build(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        n = len(values)
        size, blocks = cls.shape(n)
        planes, ranks, zeros = np.zeros((levels, size), np.uint8), np.zeros((levels, blocks), np.uint32), np.zeros(levels, np.int64)
        v = values.astype(np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels):
            bit = (v & v.dtype.type(1 << (levels - 1 - level))) != 0
            packed = np.packbits(bit)
            planes[level, : len(packed)] = packed
            ones = np.bitwise_count(planes[level].view(np.uint64)).reshape(blocks, -1).sum(axis=1, dtype=np.uint32)
            ranks[level, 1:] = np.cumsum(ones[:-1])
            zeros[level] = n - int(ones.sum())
            if level + 1 < levels:
                v = np.concatenate([v.compress(~bit), v.compress(bit)])
        return cls(n, levels, zeros, planes, ranks)

    def all(self) -> np.ndarray:
        """The whole sequence, from the last plane up: each plane puts its values back to where they stood and adds its bit."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        below = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            bit, zeros = np.unpackbits(self.planes[level], count=self.n).view(bool), int(self.zeros[level])
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = below[:zeros]
            out[np.flatnonzero(bit)] = below[zeros:] | kind(1 << (self.levels - 1 - level))
            below = out
        return below.astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i."""
        block, plane = i // BLOCK, self.planes[level]
        got = int(self.ranks[level, block]) + int(np.bitwise_count(plane[block * BLOCK // 8 : i // 8]).sum())
        return got + (int(plane[i // 8]) >> (8 - i % 8)).bit_count() if i % 8 else got

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i // 8]) >> (7 - i % 8) & 1

    def _select(self, level: int, k: int, one: bool) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        before = self.ranks[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        lo = block * BLOCK
        bits = np.unpackbits(self.planes[level, lo // 8 : (lo + BLOCK) // 8])[: self.n - lo]
        return lo + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of value before place end stand behind the last plane."""
        lo, hi = 0, end
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if value >> (self.levels - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, end: int) -> int:
        """How often value occurs before place end."""
        if value >> self.levels:
            return 0
        lo, hi = self._range(value, end)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence."""
        lo, hi = self._range(value, self.n) if not value >> self.levels else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in reversed(range(self.levels)):
            one = bool(value >> (self.levels - 1 - level) & 1)
            i = self._select(level, i - int(self.zeros[level]) if one else i, one)
        return i

    def places(self, value: int) -> list[int]:
        """All places of value, ascending."""
        return [self.select(value, k) for k in range(self.rank(value, self.n))]
