r"""Vectorised hashing of words `[^\x20\x09-\x0D]+` over the UTF-8 bytes of Arrow string columns.

A word's hash is the sum of a table's random 64-bit values, one for each of its bytes at its place,
and is mixed. Hashes of two neighbours of 1, 2, 4, ... words are joined and mixed again, and a window's
hash is put together from those. No step is linear in the words, so no pattern of words (as powers of a
base would have) makes different windows alike but by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once (a longer document is hashed alone).
CHUNK_BYTES = 500_000
MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_RANDOM = np.random.default_rng(20_240_601)
#: A random value for each byte at each place modulo PLACES of a word, one table for each hash.
PLACES = 64
_BYTES = [_RANDOM.integers(1, MASK, PLACES * 256, np.uint64) for _ in range(2)]
_TURN = np.uint64(0x9E3779B97F4A7C15)
_JOIN = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


@dataclass
class Words:
    """Words of the rows lo..hi of a batch; word i is data[start[i]:end[i]], of row lo + row[i]."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each row and one more: the number of its first word

    def hashes(self, which: int = 0) -> np.ndarray:
        """Sums of random values, one for each byte and its place in the word."""
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, np.uint64)
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        letters = self.data[~SPACE[self.data]]
        values = _BYTES[which][(place % PLACES << 8) | letters]
        if length.max() > PLACES:
            far = np.flatnonzero(place >= PLACES)
            values[far] = mix(values[far] + (place[far] // PLACES).astype(np.uint64) * _TURN)
        return mix(np.add.reduceat(values, first))

    def windows(self, hashes: np.ndarray, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        """Hashes of the k words from each word at, from hashes of 1, 2, 4, ... words."""
        found, taken, held, width = None, 0, hashes, 1
        while width <= k:
            if k & width:
                part = held[at + taken] if len(at) else np.zeros(0, np.uint64)
                found = part if found is None else mix(found * _JOIN[which] + part)
                taken += width
            if 2 * width <= k:
                held = mix(held[: len(held) - width] * _JOIN[which] + held[width:]) if len(held) > width else held[:0]
            width *= 2
        return found

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def split_words(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a string column without nulls, in chunks of whole rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(column))
        part, marks = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        n = len(part)
        edge = np.ones(n + 1, bool)  # before byte i a word may begin, and one may end
        word = ~SPACE[part]
        edge[1:n] = ~word[:-1]
        edge[marks] = True
        start = np.flatnonzero(word & edge[:n])
        edge[:n] |= ~word
        stop = np.flatnonzero(word & edge[1:]) + 1
        yield Words(lo, hi, part, start, stop, np.searchsorted(start, marks))
        lo = hi


def strings(column: pa.Array) -> pa.Array:
    """The column as string with null as empty."""
    return column.cast(pa.string()).fill_null("") if column.null_count or column.type != pa.string() else column
