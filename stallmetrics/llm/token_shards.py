"""Token ids of a corpus in shards, each a wavelet matrix in a row of a Parquet file.

encode_shards() sorts documents by doc_id over ranges, encodes whole texts with the tokenizers library,
appends the end id, and packs whole documents into shards of `shard_tokens` ids (a longer document is a
shard of its own). A shard's row has its bit-planes and rank directory, and its documents' ids and
lengths, so from one compressed file a token can be read, counted and found without decoding the rest.

Cases: null or empty text has the end id alone; a null doc_id sorts first; rows that repeat a doc_id are
documents one after the other in the order of their texts; an empty table gives no shards; the strings
of the tokenizer's added tokens in a text become those tokens, as the library has it; other columns are
not read.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, small
from .units import Units
from .wavelet import WaveletMatrix
from .words import strings

END = 2
SHARD_TOKENS = 1 << 21
#: Units that a worker keeps in one generation of its cache, and texts that it encodes at once.
CACHE, ROWS = 1_000_000, 1024
#: Pieces that go to the library in one call.
PIECES = 1024

SHARD = "part int, seq int, n_docs int, n_tokens long, levels int, zeros binary, planes binary, ranks binary, doc_ids array<long>, lengths array<long>"
_NAMES = [x.split()[0] for x in SHARD.split(", ")]


# How a byte-level tokenizer cuts text, for letters up to U+024F and ASCII, and the characters that it writes bytes as.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(f"[\t\n\r -~{_LETTERS}]*")
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}


class _Encoder:
    """The ids that the library gives for whole texts, add_special_tokens=False: strings of added tokens in a text become those tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        said = json.loads(self.tokenizer.to_str())
        cuts = said["pre_tokenizer"] or {}
        # Only of a byte-level tokenizer are a text's ids those of its units.
        self.zero = self.tokenizer.token_to_id(chr(_SPELLED[0]))
        self.by_units = self.zero is not None and not said["normalizer"] and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space", True)
        self.bare.pre_tokenizer = Split(chr(_SPELLED[0]), "isolated")
        self.pieces, self.units = Units(self._cut, CACHE), Units(self._each, CACHE // 8)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _each(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _cut(self, pieces: list[str]) -> list[bytes]:
        """Many pieces go to the library in a call, with a zero byte, which no plain text has, behind each; its id tells where each ends."""
        out: list[bytes] = []
        for i in range(0, len(pieces), PIECES):
            given = "\0".join([*pieces[i : i + PIECES], ""]).encode().decode("latin-1")
            for byte, spelled in _SPELLED.items():  # many times faster than translate()
                given = given.replace(chr(byte), chr(spelled))
            ids = np.array(self.bare.encode_batch_fast([given], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.zero)).tolist()
            out += [data[a:b] for a, b in zip([0, *[x + 4 for x in ends]], ends, strict=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Plain texts by their pieces, others by their units, those that have an added token by the library alone."""
        out: list[bytes] = [b""] * len(texts)
        plain, others = [], []
        for i, t in enumerate(texts):
            if not self.by_units or any(a in t for a in self.added):
                out[i] = self._whole(t)
            else:
                (plain if _PLAIN.fullmatch(t) else others).append(i)
        for at, ids in ((plain, self.pieces.joined(_PIECES.findall(texts[i]) for i in plain)), (others, self.units.encode([texts[i] for i in others]))):
            for i, x in zip(at, ids, strict=True):
                out[i] = x
        return out


_encoder = functools.cache(_Encoder)


def _shard(part: int, seq: int, levels: int, ids: list[bytes], doc_ids: list) -> pa.RecordBatch:
    values = np.frombuffer(b"".join(ids), "<u4")
    m = WaveletMatrix.build(values, levels)
    one = [part, seq, len(ids), len(values), levels, m.zeros.tobytes(), m.planes.tobytes(), m.ranks.tobytes()]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (doc_ids, [len(x) // 4 for x in ids])]
    return pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in zip(one, types, strict=True)], *lists], names=_NAMES)


def _shards(path: str, end: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    size = max(encoder.size, END + 1)
    levels, stop = max(1, (max(size, end + 1) - 1).bit_length()), np.array([end], "<u4").tobytes()
    part, seq, held = TaskContext.get().partitionId(), 0, 0
    ids: list[bytes] = []
    doc_ids: list = []
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            rows = batch.slice(i, ROWS)
            for doc_id, x in zip(rows.column("doc_id").to_pylist(), encoder.encode(strings(rows.column("text")).to_pylist()), strict=True):
                if held and held + len(x) // 4 + 1 > most:
                    yield _shard(part, seq, levels, ids, doc_ids)
                    ids, doc_ids, held, seq = [], [], 0, seq + 1
                ids.append(x + stop)
                doc_ids.append(doc_id)
                held += len(x) // 4 + 1
    if ids:
        yield _shard(part, seq, levels, ids, doc_ids)


def encode_shards(docs: DataFrame, path: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows of SHARD; (part, seq) is their order. path is read on the executors."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return in_arrow(rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text"), lambda b: _shards(path, end, shard_tokens, b), SHARD)


def write_shards(docs: DataFrame, path: str, to: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards to the folder `to` and returns them as read from there."""
    encode_shards(docs, path, end, shard_tokens).write.option("compression", "zstd").parquet(to)
    return docs.sparkSession.read.schema(SHARD).parquet(to)


def load(row: dict) -> WaveletMatrix:
    n, levels = row["n_tokens"], row["levels"]
    size, blocks = WaveletMatrix.shape(n)
    return WaveletMatrix(n, levels, np.frombuffer(row["zeros"], np.int64), np.frombuffer(row["planes"], np.uint8).reshape(levels, size), np.frombuffer(row["ranks"], np.uint32).reshape(levels, blocks))


def starts(shards: DataFrame) -> DataFrame:
    """shards with start: the ids in all shards before. Only the totals of parts, one for each task that wrote, meet in one place."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select(F.col("part").alias("of"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    sizes = shards.select("part", "seq", "n_tokens")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    placed = sizes.withColumn("within", within).join(before, F.col("part") == F.col("of")).select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("before") + F.col("within")).alias("start"))
    return shards.join(small(placed), (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).drop("p", "s")


_DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            (row,) = batch.slice(i, 1).to_pylist()
            ids, ends = load(row).all(), np.cumsum(row["lengths"])
            starts_ = ends - row["lengths"]
            for a in range(0, len(ends), ROWS):
                b = min(a + ROWS, len(ends))
                parts = [ids[x:y].tobytes() for x, y in zip(starts_[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(starts_[a:b] + row["start"]), pa.array(row["lengths"][a:b], pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of each document, from the bit-planes."""
    return in_arrow(starts(shards), _documents, _DOCUMENT)


def _per_shard(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            (row,) = batch.slice(i, 1).to_pylist()
            yield of(row, load(row))


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """part, seq, n: how often each shard has the token, by rank."""
    of = lambda row, m: pa.RecordBatch.from_pylist([{"part": row["part"], "seq": row["seq"], "n": m.rank(token, m.n)}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64())]))
    return shards.mapInArrow(lambda b: _per_shard(b, of), "part int, seq int, n long")


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """at: each place of the token in the whole sequence, by select."""
    of = lambda row, m: pa.RecordBatch.from_arrays([pa.array([row["start"] + x for x in m.places(token)], pa.int64())], names=["at"])
    return starts(shards).mapInArrow(lambda b: _per_shard(b, of), "at long")


