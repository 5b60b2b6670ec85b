r"""Token counts of sections or fields by offset mapping.

A document is encoded once, as a whole. Each token has a span of characters (from the character that its
first byte is of to the one that its last byte is of), and each section has one. Sorted spans are joined as
intervals by binary search; a token inside one section is that section's. A token that crosses a border is
allocated by a rule:

    first, last   to the first or last section that it overlaps
    most          to the one that has most of its characters, of equals the first
    split         to each in proportion to its characters (counts are then fractions)

A token that overlaps no section is counted as `outside`, so counts always add up to the document's.

Cases: null or empty text has one empty section without tokens; an empty section gets none; sections have to
be in order and not overlap; repeated rows get equal results; an empty table gives an empty result; special
tokens in a text are ordinary text; texts are encoded whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .bpe import ranks, tokens
from .units import Units
from .words import strings

RULES = ("first", "last", "most", "split")
ROWS = 512


@functools.cache
def _units(path: str, pattern: str) -> Units:
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return Units(lambda units: [np.array(encoding.encode_ordinary(u), "<u4").tobytes() for u in units])


def token_spans(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one behind the last character of each token, from the text's bytes and the tokens' lengths in bytes."""
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    end = np.cumsum(lengths)
    return character[end - lengths], character[end - 1] + 1


def allocate(first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section lo[i]:hi[i] (ascending), and those outside all, for token spans first:last (ascending)."""
    counts, outside = np.zeros(len(lo)), 0.0
    if not len(first):
        return counts, outside
    full = np.flatnonzero(hi > lo)  # an empty section overlaps nothing
    if not len(full):
        return counts, float(len(first))
    a, b = lo[full], hi[full]
    i = np.searchsorted(b, first, "right")  # the first section that ends behind the token's begin
    j = np.searchsorted(a, last, "left") - 1  # the last one that begins before its end
    inside = i == j
    counts[full] += np.bincount(i[inside], minlength=len(full))
    outside += float(np.count_nonzero(j < i))
    crossing = np.flatnonzero(i < j)
    for t in crossing.tolist():
        over = np.arange(i[t], j[t] + 1)
        share = np.minimum(b[over], last[t]) - np.maximum(a[over], first[t])
        if rule == "split":
            counts[full[over]] += share / share.sum()
        else:
            counts[full[over[{"first": 0, "last": -1, "most": int(share.argmax())}[rule]]]] += 1
    return counts, outside


_RESULT = "doc_id long, section int, start long, end long, n_tokens double, outside double, doc_tokens long"


def _attributed(path: str, pattern: str, rule: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lengths_of = tokens(path).lengths
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            rows = batch.slice(at, ROWS)
            texts = strings(rows.column("text")).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text, ids, given in zip(rows.column("doc_id").to_pylist(), texts, _units(path, pattern).encode(texts), rows.column("spans"), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                first, last = token_spans(data, lengths_of[np.frombuffer(ids, "<u4")])
                if given.is_valid:
                    lo, hi = (given.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                else:
                    ends = np.flatnonzero(data == 10)
                    character = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                    lo, hi = np.r_[0, character[ends + 1]], np.r_[character[ends + 1], character[-1]]
                counts, outside = allocate(first, last, lo, hi, rule)
                n = len(lo)
                for column, values in zip(out, ([doc_id] * n, range(n), lo.tolist(), hi.tolist(), counts.tolist(), [outside] * n, [len(first)] * n), strict=True):
                    column.extend(values)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split()[0] for x in _RESULT.split(", ")])


def attribute(docs: DataFrame, path: str, pattern: str, rule: str = "most", spans: Column | None = None) -> DataFrame:
    r"""Rows of doc_id, section (from 0), start, end (characters), n_tokens, outside, doc_tokens.

    spans: a list of (start, end) for each document, ascending; without it, or where it is null, sections
    are the text's lines, each with the \n that ends it.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    kind = "array<struct<start: bigint, end: bigint>>"
    given = F.lit(None) if spans is None else spans
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), given.cast(kind).alias("spans"))
    return in_arrow(rows, lambda b: _attributed(path, pattern, rule, b), _RESULT)


def with_fields(df: DataFrame, fields: list[str], between: str = "\n") -> DataFrame:
    """df with text, the fields one after the other (null: empty), and spans, where each of them stands."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    spans, at = [], F.lit(0).cast("long")
    for p in parts:
        spans.append(F.struct(at.alias("start"), (at + F.length(p)).alias("end")))
        at = at + F.length(p) + len(between)
    return df.withColumns({"text": F.concat_ws(between, *parts), "spans": F.array(*spans)})


def totals(attributed: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens and sections by columns of attributed, such as section (the field)."""
    return attributed.groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_sections"))
