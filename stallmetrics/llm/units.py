r"""Token ids of whole texts put together from the ids of their units.

A unit begins with a blank (or with white space of any kind, or where the text begins) and ends before
the next white space. The pieces that the pattern of a byte-level BPE matches never cross the place
where a unit begins, so a text's ids are its units' ids one after the other, and units that come again
are encoded once for each worker. A generation of the cache ends with the texts in which it reaches `limit`
units, and the one before is kept; what is no longer there is encoded anew, so the limit changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import regex

#: Units in one generation of the cache.
LIMIT = 150_000
_UNITS = regex.compile(r"\s*\S+|\s+")


class _Numbers(dict):
    """Numbers units as they come; fresh has those that have no ids yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.fresh.append(unit)
        return number


class _Ids:
    """Ids of numbered units, one after the other in an array that grows; unit i's go from the i-th end to the next."""

    def __init__(self):
        self.numbers, self.n = _Numbers(), 0
        self._ids, self._ends = np.zeros(1 << 12, "<u4"), np.zeros(1 << 10, np.int64)

    @staticmethod
    def _room(held: np.ndarray, n: int) -> np.ndarray:
        return held if n <= len(held) else np.concatenate([held, np.zeros(max(n, 2 * len(held)) - len(held), held.dtype)])

    def add(self, units: list[bytes]) -> None:
        first, before, self.n = self.n, int(self._ends[self.n]), self.n + len(units)
        ends = before + np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) // 4)
        self._ends = self._room(self._ends, self.n + 1)
        self._ends[first + 1 : self.n + 1] = ends
        self._ids = self._room(self._ids, int(ends[-1]))
        self._ids[before : int(ends[-1])] = np.frombuffer(b"".join(units), "<u4")

    def of(self, number: int) -> bytes:
        return self._ids[self._ends[number] : self._ends[number + 1]].tobytes()

    def joined(self, numbers: list[np.ndarray]) -> list[bytes]:
        """The ids of each text, given by its units' numbers."""
        if not numbers:
            return []
        every = np.concatenate(numbers)
        upto = self._ends[every + 1]
        n = upto - self._ends[every]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._ids[np.repeat(upto - ends, n) + np.arange(total)]
        stops = np.r_[0, ends][np.cumsum([len(x) for x in numbers])].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *stops], stops, strict=False)]


class Units:
    """encode gives, for texts, their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = LIMIT):
        self._encode, self._limit = encode, limit
        self._new, self._old = _Ids(), _Ids()

    def _learn(self, fresh: list[str]) -> None:
        """Ids of fresh units: from the old generation where it has them."""
        if not self._old.n:
            return self._new.add(self._encode(fresh))
        at = [self._old.numbers.get(u) for u in fresh]
        coded = iter(self._encode([u for u, i in zip(fresh, at, strict=True) if i is None]))
        self._new.add([next(coded) if i is None else self._old.of(i) for i in at])

    def joined(self, split: Iterable[list[str]]) -> list[bytes]:
        """The ids of texts that have been split into units."""
        if len(self._new.numbers) >= self._limit:
            self._old, self._new = self._new, _Ids()
        numbers = self._new.numbers
        found = [np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts)) for parts in split]
        if numbers.fresh:
            fresh, numbers.fresh = numbers.fresh, []
            self._learn(fresh)
        return self._new.joined(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Call it with a few hundred texts at a time: all their units are held."""
        split = []
        for text in texts:
            parts = text.split(" ")
            # A part that is empty or begins with white space means a run of it; its units have to be found with care.
            if "" in parts or any(map(str.isspace, {p[0] for p in parts})):
                parts = _UNITS.findall(text)
            else:
                parts = [f" {p}" for p in parts]
                parts[0] = parts[0][1:]
            split.append(parts)
        return self.joined(split)
