r"""SentencePiece encoding by a table of distinct chunks, and decoding.

The library writes a blank as a marker (U+2581) and puts one before the text. A chunk is a run of markers
and what follows up to the next marker: a marked word. Where no piece has a marker behind another character,
no merge joins two chunks, so a text's ids are its chunks' ids one after the other. Each worker keeps a table
of the distinct chunks that it has met: a chunk is segmented once, by the library, and gets a row in the
table; the texts become arrays of row numbers, and the ids are joined back to them by position.

One table for the whole corpus would be joined by shuffling every word of it; the workers' own tables move
nothing, and segment a chunk again at most once for each worker and generation. A table is bounded: when a
generation has CHUNKS rows the next begins, and the one before is kept to look in (see units.py).

A model whose pieces cross markers, that is no BPE, or whose text rules are others (a normalizer, no marker
before the text, user-defined pieces) is left to the library, text by text.

Cases: null or empty text has the begin and end ids alone (no id if they are turned off); U+2581 in a text is
a blank, as the library has it, so such a text is decoded with blanks; names of control pieces in a text are
ordinary text; repeated rows get equal results; a null doc_id is kept; an empty table gives an empty result;
texts are encoded whole, however long; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .units import Units
from .words import strings

#: Texts that are split at once, and rows of one generation of a worker's table of chunks.
ROWS, CHUNKS = 512, 300_000
MARK = "▁"
_CHUNK = re.compile(r" +[^ ]*")


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker, which the library puts there; later markers are blanks."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _CHUNK.findall(f" {text}")]
    return text.split(" ")


class Pieces:
    """A model with its table of distinct chunks."""

    def __init__(self, path: str, limit: int = CHUNKS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        said = proto.ModelProto()
        said.ParseFromString(self.library.serialized_model_proto())
        rules, kinds = said.normalizer_spec, proto.ModelProto.SentencePiece
        self.by_chunks = (
            said.trainer_spec.model_type == proto.TrainerSpec.BPE
            and not said.trainer_spec.treat_whitespace_as_suffix
            and not rules.precompiled_charsmap
            and rules.add_dummy_prefix
            and rules.escape_whitespaces
            and not rules.remove_extra_whitespaces
            and not any(p.type == kinds.USER_DEFINED or re.search(f"[^{MARK}]{MARK}", p.piece) for p in said.pieces)
        )
        # To the library the empty text has no marker, but as a chunk it is the marker that a text ends in.
        self.lone = np.array(self.library.encode("\n ")[len(self.library.encode("\n")) :], "<u4").tobytes()
        self.table = Units(lambda cs: [x or self.lone for x in self._segment(cs)], limit)

    def _segment(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x)}I", *x) for x in self.library.encode(texts, num_threads=1)] if texts else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without begin and end."""
        return self.table.joined(map(chunks, texts)) if self.by_chunks else self._segment(texts)


pieces = functools.cache(Pieces)


def _encoded(path: str, ends: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    begin, end = (np.array([i], "<u4").tobytes() if ends and i >= 0 else b"" for i in (model.library.bos_id(), model.library.eos_id()))
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            part = batch.slice(i, ROWS)
            ids = [begin + x + end for x in model.encode(strings(part.column("text")).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, path: str, ends: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) for each row of docs; ends: with begin and end ids. path is read on the executors."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return in_arrow(rows, lambda b: _encoded(path, ends, b), "doc_id long, n_tokens long, ids binary")


def _decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    library = pieces(path).library
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            part = batch.slice(i, ROWS)
            texts = [library.decode(np.frombuffer(x, "<u4").tolist()) if x else "" for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded: the text of its ids, as the library gives it (null ids: empty)."""
    return in_arrow(encoded, lambda b: _decoded(path, b), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema)}, decoded string")
