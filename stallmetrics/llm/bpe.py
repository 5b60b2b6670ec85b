r"""Byte-level BPE by dynamic programming over prefixes.

The encoding of each prefix of a piece ends in one token: the only one that, behind the encoding of
what stands before it, BPE would not merge differently. A table of these last tokens gives a piece's
ids by walking back from its end, lets bytes be appended exactly (no earlier entry changes) and an
edit be re-encoded from where it begins until the entries agree with the old ones again.

Two tokens may follow each other if no merge across their border comes before the merges that made
them; that is decided by undoing their merges from the latest one on.

Cases: null or empty text has no ids; each match of the pattern is encoded by itself; special tokens
in a text are ordinary text; repeated rows get equal results; an empty table gives an empty result;
texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .units import Units
from .words import strings

#: Texts that are encoded at once.
ROWS = 1024
#: Units in one generation of a worker's cache, and pieces whose ids it keeps besides.
CACHE, PIECES = 200_000, 100_000
_NONE = 1 << 62
# Characters that `regex` has as letters or numbers and tiktoken, whose Unicode is older, does not.
_NEWER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: Stands for those where pieces are found: no letter, number or white space.
_STAND_IN = "\ue000"


class Vocabulary:
    """ranks: of each token's bytes; every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.longest = max(map(len, ranks))
        # A trie of the tokens read from their ends: node * 256 + byte gives the next node, and a node its token.
        self._before: dict[int, int] = {}
        self._token_at = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                node = self._before.get(key, 0)
                if not node:
                    node = self._before[key] = len(self._token_at)
                    self._token_at.append(-1)
            self._token_at[node] = i
        self._left, self._right = list(range(self.size)), list(range(self.size))
        self._pairs: dict[int, int] = {}
        self._may: dict[int, bool] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut], _NONE), ranks.get(token[cut:], _NONE)
                if a < i and b < i and self._compatible(a, b):
                    self._left[i], self._right[i] = a, b
                    self._pairs[a * self.size + b] = i
                    break
        self._may.clear()

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b as they are where a's bytes stand before b's."""
        pairs, size, left, right, limit = self._pairs, self.size, self._left, self._right, _NONE
        while True:
            if pairs.get(a * size + b, _NONE) < limit:
                return False
            # Undo the later merge; a merge across the border counts only if it comes before that one.
            # Of equal ranks the one further left comes first.
            undo_a = a > b
            if (left[a] if undo_a else left[b]) == (a if undo_a else b):
                undo_a = not undo_a
                if (left[a] if undo_a else left[b]) == (a if undo_a else b):
                    return True
            if undo_a:
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.size + b
        found = self._may.get(key)
        if found is None:
            if len(self._may) > 1_000_000:
                self._may.clear()
            found = self._may[key] = self._compatible(a, b)
        return found

    def extend(self, data: bytes, last: list[int], old: list[int] | None = None) -> None:
        """Appends to last, which has the last tokens of data's first prefixes, those of the others.

        old: last tokens of a text that ends as data does; once as many entries as the longest token is long agree, the rest is taken from it.
        """
        before, token_at, may, agree = self._before.get, self._token_at, self._may, 0
        size, compatible = self.size, self.compatible
        shift = len(old) - len(data) if old is not None else 0
        for end in range(len(last) + 1, len(data) + 1):
            found, node, start = [], 0, end
            while start:
                node = before(node << 8 | data[start - 1], 0)
                if not node:
                    break
                start -= 1
                if token_at[node] >= 0:
                    found.append((start, token_at[node]))
            for start, token in reversed(found):
                if start:
                    a = last[start - 1]
                    fits = may.get(a * size + token)
                    if not (compatible(a, token) if fits is None else fits):
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"no token for byte {data[end - 1]}")
            if old is not None and end + shift > 0:
                agree = agree + 1 if old[end + shift - 1] == last[-1] else 0
                if agree >= self.longest:
                    last += old[end + shift :]
                    return

    def walk(self, last: list[int]) -> list[int]:
        """The ids of the whole, from the last tokens of its prefixes."""
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.walk(last)


class Tokens:
    """The bytes of all tokens, for decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.lengths = np.array([len(x) for x in tokens])
        self._from = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        n = self.lengths[ids]
        end = np.cumsum(n)
        return self._bytes[np.repeat(self._from[ids] - end + n, n) + np.arange(end[-1] if len(end) else 0)]


class PrefixTable:
    """A piece with the last tokens of its prefixes, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.data, self.last)

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Puts data in the place of the bytes from start to end."""
        old, tail = self.last, len(self.data) - end
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[:start]
        known = len(self.data) - tail
        if known > start:
            self.vocabulary.extend(self.data[:known], self.last)
        self.vocabulary.extend(self.data, self.last, old)

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last)


def ranks(path: str) -> dict[bytes, int]:
    """From a file of lines: base64 of a token, blank, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Read once for each worker."""
    return Vocabulary(ranks(path))


@functools.cache
def tokens(path: str) -> Tokens:
    return Tokens(ranks(path))


def cut(pieces: regex.Pattern, text: str) -> list[str]:
    """The matches of a pattern in a text, with letters and numbers as tiktoken has them."""
    if text.isascii() or not _NEWER.search(text):
        return pieces.findall(text)
    return [text[m.start() : m.end()] for m in pieces.finditer(_NEWER.sub(_STAND_IN, text))]


def _shared(a: bytes, b: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


@functools.cache
def _units(path: str, pattern: str) -> Units:
    v, pieces = vocabulary(path), regex.compile(pattern)
    one: dict[str, bytes] = {}

    def encode(units: list[str]) -> list[bytes]:
        # Letters, or a blank and letters, are one piece.
        split = [(u,) if u.isalpha() or (u[0] == " " and u[1:].isalpha()) else cut(pieces, u) for u in units]
        if len(one) > PIECES:
            one.clear()
        # In their order, a piece goes on from the prefixes that it shares with the one before.
        data, last = b"", []
        for new, piece in sorted((p.encode(), p) for p in {p for ps in split for p in ps if p not in one}):
            if (whole := v.ranks.get(new)) is not None:
                ids = [whole]
            else:
                del last[_shared(data, new) :]
                data = new
                v.extend(data, last)
                ids = v.walk(last)
            one[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return [one[ps[0]] if len(ps) == 1 else b"".join([one[p] for p in ps]) for ps in split]

    return Units(encode, CACHE)


def _encoded(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            part = batch.slice(i, ROWS)
            ids = _units(path, pattern).encode(strings(part.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) for each row of docs; path is read on the executors."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return in_arrow(rows, lambda b: _encoded(path, pattern, b), "doc_id long, n_tokens long, ids binary")


def _decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = tokens(path)
    for batch in batches:
        decoded = [v.decode(np.frombuffer(x, "<u4")).tobytes() for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded: the bytes of its ids."""
    return in_arrow(encoded, lambda b: _decoded(path, b), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded binary")


def append(ids: bytes, text: str, more: str, path: str, pattern: str) -> bytes:
    """The ids of text + more, from the ids of text: only from text's last unit on is anything encoded."""
    v, pieces = vocabulary(path), regex.compile(pattern)
    start = max((m.start() for m in regex.finditer(r"\s*\S+|\s+", text)), default=0)
    head = sum(len(v.piece(p.encode())) for p in cut(pieces, text[start:]))
    tail = [i for p in cut(pieces, text[start:] + more) for i in v.piece(p.encode())]
    return ids[: len(ids) - 4 * head] + np.array(tail, "<u4").tobytes()
