r"""Exact removal of long repeated word sequences by difference-cover anchors.

A window is `window` consecutive words `[^\x20\x09-\x0D]+` of one document. A word goes if a
window that covers it has the same words as a window that starts anywhere else, the same
document included; windows are judged on the input.

Method. COVER is a difference cover of PERIOD: each difference modulo PERIOD is one of two of
its members. So two equal windows that start at i and j have an offset d < PERIOD for which
both i + d and j + d are cover positions, and the anchors there (window - PERIOD + 1 words)
are equal. Phase 1 hashes anchors at cover positions alone and finds those that occur twice.
Phase 2 extends them: each window that holds a repeated anchor is hashed (96 bits) and counted.
Phase 3 takes the words covered by repeated windows out of the texts.

No group is ever gathered: a batch sends each hash once, however often it holds it, so a hash
that a third of all documents share has as many rows as there are batches; places that are
equal within a batch are known at once and don't wait for the count.

Cases: null or empty text has no words; a document under `window` words is kept whole; rows that
repeat a doc_id with the same text are each other's copies; with other texts they are documents
of their own; a null doc_id is a key like another; an empty table gives an empty result; columns
besides doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, in_arrow, keyed
from .words import Words, mix, split_words, strings

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)

_IS_COVER = np.isin(np.arange(PERIOD), COVER)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PLACES = "k1 long, k2 int, doc_id long, th long, at int, copies int, known binary"
_PLACES_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("copies", pa.int32()), ("known", pa.binary())])


def _spans(at: np.ndarray) -> bytes:
    """Ascending places as runs: first and length of each, 32-bit."""
    first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    return np.stack([at[first], np.diff(np.r_[first, len(at)])], axis=1).astype(np.int32).tobytes()


def _places(spans: list[bytes] | None) -> np.ndarray:
    found = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in spans or ()]
    return np.concatenate([np.arange(a, a + n) for x in found for a, n in x] or [np.zeros(0, np.int64)])


def _batch_of_places(k1: np.ndarray, k2: np.ndarray, row: np.ndarray, at: np.ndarray, doc_id: pa.Array, th: pa.Array) -> Iterator[pa.RecordBatch]:
    """One row for each key of the batch, and one with the known places for each document that has a key twice."""
    if not len(k1):
        return
    order = np.lexsort((k2, k1))
    new = np.r_[True, (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)]
    first = np.flatnonzero(new)
    copies = np.diff(np.r_[first, len(order)])
    one, lead = copies == 1, order[first]
    nothing = pa.nulls(len(lead), pa.binary())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(k1[lead].view(np.int64)), pa.array(k2[lead]), doc_id.take(pa.array(row[lead])), th.take(pa.array(row[lead])),
            pa.array(np.where(one, at[lead], -1).astype(np.int32)), pa.array(np.minimum(copies, 2).astype(np.int32)), nothing,
        ],
        schema=_PLACES_ARROW,
    )
    again = np.sort(order[np.repeat(~one, copies)])
    if len(again):
        rows = row[again]
        cut = np.flatnonzero(np.diff(rows)) + 1
        spans = [_spans(x) for x in np.split(at[again], cut)]
        whose = pa.array(rows[np.r_[0, cut]])
        n = len(spans)
        ids, ths = doc_id.take(whose), th.take(whose)
        # They wait for no count; their key only keeps copies of one text from meeting in one task.
        own = mix(ths.to_numpy().view(np.uint64) + ids.fill_null(0).to_numpy().view(np.uint64) * _SPREAD)
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.zeros(n, np.int32)), ids, ths, pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(spans, pa.binary())], schema=_PLACES_ARROW)


def _anchor_places(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = window - PERIOD + 1
    for batch in batches:
        keys, rows, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for words in split_words(strings(batch.column("text"))):
            n = np.diff(words.first)
            at = np.arange(words.first[-1]) - np.repeat(words.first[:-1], n)
            n = np.repeat(n, n)
            here = np.flatnonzero(_IS_COVER[at % PERIOD] & (n - at >= width) & (n >= window))
            keys.append(words.windows(words.hashes(), here, width))
            rows.append(words.row[here] + words.lo)
            places.append(at[here])
        key = np.concatenate(keys)
        yield from _batch_of_places(key, np.zeros(len(key), np.int32), np.concatenate(rows), np.concatenate(places), batch.column("doc_id"), batch.column("th"))


def _per_row(words: Words, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of words: its number and its places."""
    at, known = batch.column("at"), batch.column("known")
    for i in range(words.lo, words.hi):
        listed = at[i].values
        yield i - words.lo, np.concatenate([_places(known[i].as_py()), np.zeros(0, np.int64) if listed is None else listed.to_numpy(zero_copy_only=False)]).astype(np.int64)


def _window_places(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2, rows, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for words in split_words(strings(batch.column("text"))):
            total = int(words.first[-1])
            opened = np.zeros(total + 1, np.int32)
            for i, at in _per_row(words, batch):
                lo, hi = words.first[i], words.first[i + 1] - window
                a = at + lo
                begin, end = np.maximum(a - PERIOD + 1, lo), np.minimum(a, hi)
                fits = begin <= end
                np.add.at(opened, begin[fits], 1)
                np.add.at(opened, end[fits] + 1, -1)
            here = np.flatnonzero(np.cumsum(opened[:-1]) > 0)
            if len(here):
                k1.append(words.windows(words.hashes(0), here, window, 0))
                k2.append((words.windows(words.hashes(1), here, window, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                row = words.row[here]
                rows.append(row + words.lo)
                places.append(here - words.first[row])
        yield from _batch_of_places(np.concatenate(k1), np.concatenate(k2), np.concatenate(rows), np.concatenate(places), batch.column("doc_id"), batch.column("th"))


def _repeated(places: DataFrame) -> DataFrame:
    """For each document with places whose key occurs twice or more: doc_id, th, at list, known list."""
    by_key = Window.partitionBy("k1", "k2", F.col("copies") == 0)
    twice = places.withColumn("total", F.sum("copies").over(by_key)).filter(F.col("known").isNotNull() | ((F.col("total") >= 2) & (F.col("at") >= 0)))
    return twice.groupBy("doc_id", "th").agg(F.collect_list(F.when(F.col("at") >= 0, F.col("at"))).alias("at"), F.collect_list("known").alias("known"))


def _with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    places = places.withColumnsRenamed({"doc_id": "p_doc_id", "th": "p_th"})
    on = (docs["th"] == places["p_th"]) & docs["doc_id"].eqNullSafe(places["p_doc_id"])
    return docs.join(places, on, how).drop("p_doc_id", "p_th")


def _phase1(docs: DataFrame, window: int) -> Stored:
    return Stored(_repeated(in_arrow(docs, lambda b: _anchor_places(window, b), _PLACES)), "anchors")


def _phase2(docs: DataFrame, anchors: DataFrame, window: int) -> Stored:
    return Stored(_repeated(in_arrow(_with_places(docs, anchors, "inner"), lambda b: _window_places(window, b), _PLACES)), "windows")


_RESULT = "doc_id long, th long, n_words long, n_removed long, kept string"


def _removals(window: int, one_blank: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for words in split_words(strings(batch.column("text"))):
            total = int(words.first[-1])
            opened = np.zeros(total + 1, np.int32)
            for i, at in _per_row(words, batch):
                a = at + words.first[i]
                np.add.at(opened, a, 1)
                np.add.at(opened, a + window, -1)
            stays = np.cumsum(opened[:-1]) == 0
            data = words.data.tobytes()
            for i in range(words.hi - words.lo):
                lo, hi = words.first[i], words.first[i + 1]
                at = np.flatnonzero(stays[lo:hi]) + lo
                n_words.append(int(hi - lo))
                n_removed.append(int(hi - lo - len(at)))
                if not len(at):
                    kept.append("")
                    continue
                start, end = words.start[at], words.end[at]
                # A run of kept words is one slice of the text; with one_blank, if they stand one blank apart.
                joined = np.diff(at) == 1
                if one_blank:
                    joined &= (start[1:] == end[:-1] + 1) & (words.data[np.minimum(end[:-1], len(words.data) - 1)] == 32)
                cut = np.flatnonzero(~joined)
                kept.append(b" ".join([data[a:b] for a, b in zip(start[np.r_[0, cut + 1]], end[np.r_[cut, len(end) - 1]], strict=True)]).decode())
        more = [c for c in batch.schema.names if c == "row"]
        columns = [batch.column("doc_id"), batch.column("th"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), *[batch.column(c) for c in more]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n_words", "n_removed", "kept", *more])


def remove_repeats(docs: DataFrame, window: int = WINDOW, one_blank: bool = True, others: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, th (see keyed), n_words, n_removed, kept.

    kept: the words that stay, one blank apart; without one_blank, runs of them keep their own white space.
    others: columns of docs that the result has in the struct row.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words or more")
    plain = keyed(docs)
    anchors = _phase1(plain, window)
    windows = _phase2(plain, anchors.df, window)
    anchors.drop()
    if others:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), F.struct(*others).alias("row"))
    joined = _with_places(plain, windows.df, "left")
    schema = T.StructType([*T.StructType.fromDDL(_RESULT), *[f for f in joined.schema if f.name == "row"]])
    return in_arrow(joined, lambda b: _removals(window, one_blank, b), schema)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with texts without their repeated passages; a text that has none stays as it is. n_chars, if there, is counted anew."""
    others = [c for c in docs.columns if c != "text"]
    found = remove_repeats(docs, window, one_blank=False, others=[*others, "text"])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
