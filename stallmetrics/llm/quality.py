r"""Quality rules: base counts and the distance of a document's distributions from its language's.

Words are `[^\x20\x09-\x0D]+` of the whole text. Base rules: n_words < MIN_WORDS, or over half of the
words in 3-word windows that the text has twice or more (counted by 64-bit hashes within the document).

Method. A document has two histograms: of character classes (CLASSES) and of common words (COMMON, one
more bin for all other words). A language's reference is the mean of the histograms of all its distinct
texts that pass the base rules, over the whole corpus: copies count once, so that a text that is copied
often doesn't become the reference. A document is kept if the Jensen-Shannon distance (the
root of the divergence, base 2) to its language's reference is at most the limit for each histogram.

Minimum-length guards: a short text strays from its language's reference by chance, so a limit is
limit + spread / sqrt(n) for n characters or words, and a histogram of under MIN_CHARS characters or
MIN_COMMON words decides nothing.

Cases: null text is like empty text: no words, base_failed; a document with a null lang, or a lang none
of whose documents passes the base rules, is held against the references of all languages and kept if it is
near one of them (against the mean of all documents only where no language has a reference); repeated rows
get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, in_arrow, small
from .words import Words, mix, split_words, strings

#: Bytes of text whose features are counted at once; a longer document alone.
CHUNK_BYTES = 256_000
#: Bytes of whole rows that go to a Python worker at once.
BATCH_BYTES = 4_000_000
MIN_WORDS = 50
MIN_CHARS = 200
MIN_COMMON = 50
#: Set on the labelled documents of the sf0.1 tables: of those that pass the base rules 99.9 % of quality 1 and 2 % of quality 0 stay.
CLASS_LIMIT, CLASS_SPREAD = 0.16, 2.0
COMMON_LIMIT, COMMON_SPREAD = 0.18, 1.3

# Frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all we when there can more if no her so who",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei einer um am sind noch wie einem über so zum war",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux mais comme nous on cette ses elle leur tout été",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo ser son",
}
COMMON = tuple(sorted({w for words in COMMON_WORDS.values() for w in words.split()}))

#: Classes of characters, told by the first byte of their UTF-8.
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "letter beyond ASCII", "other beyond ASCII")
_CLASS = np.full(256, -1, np.int8)  # the bytes that continue a character stay -1
for _i, _of in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:?!", "'\"()-")):
    _CLASS[list(_of.encode())] = _i
_CLASS[:128][_CLASS[:128] < 0] = 6
_CLASS[0xC3:0xF0] = 7
_CLASS[[0xC2, 0xE2, *range(0xF0, 0x100)]] = 8
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_STARTS = (np.arange(256) & 0xC0) != 0x80
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    words = next(split_words(pa.array([" ".join(COMMON)])))
    hashes = words.hashes()
    order = np.argsort(hashes)
    return hashes[order], order


_HASHES, _WHICH = _common_hashes()


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over first[i]:first[i + 1]."""
    return np.diff(np.r_[0, np.cumsum(flags)][first])


def _repeat_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """For each row: the words in 3-word windows that it has twice or more."""
    row, total = words.row, len(hashes)
    covered = np.zeros(total + 1, np.int32)
    if total >= 3:
        at = np.flatnonzero(row[2:] == row[:-2])
        key = words.windows(hashes, at, 3) ^ mix(row[at].astype(np.uint64))
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        again = at[order[np.r_[same, False] | np.r_[False, same]]]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 3, -1)
    return _sums(np.cumsum(covered[:-1]) > 0, words.first)


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.strip(" \t\n\v\f\r"))
        seen.add(line)
    return n


_FEATURES = "doc_id long, lang string, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, classes array<int>, common array<int>"


def _counted(text: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """lo, hi and the columns of _FEATURES from n_words on for groups of rows."""
    for words in split_words(text, CHUNK_BYTES):
        rows = words.hi - words.lo
        part = text.slice(words.lo, rows)
        ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + rows + 1].astype(np.int64)
        of_byte = ends - ends[0]
        # Bytes by value for each row, then values by class.
        byte_row = np.repeat(np.arange(rows, dtype=np.int32) << 8, np.diff(of_byte)) | words.data
        seen = np.bincount(byte_row, minlength=rows << 8).reshape(rows, 256)
        classes = np.stack([seen[:, _CLASS == c].sum(axis=1) for c in range(len(CLASSES))], axis=1)
        folded = Words(words.lo, words.hi, _FOLD[words.data], words.start, words.end, words.first).hashes()
        found = np.minimum(np.searchsorted(_HASHES, folded), len(_HASHES) - 1)
        which = np.where(_HASHES[found] == folded, _WHICH[found], len(COMMON))
        bins = len(COMMON) + 1
        common = np.bincount(words.row * bins + which, minlength=rows * bins).reshape(rows, -1)
        lists = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.astype(np.int32).ravel()))
        counts = [
            np.diff(words.first), classes.sum(axis=1) - classes[:, 3], seen[:, _SYMBOL].sum(axis=1),
            np.array([_dup_lines(t) for t in part.to_pylist()], np.int64), _repeat_words(words, words.hashes()), classes.sum(axis=1),
        ]
        yield words.lo, words.hi, [*[pa.array(c.astype(np.int64)) for c in counts], lists(classes), lists(common)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns besides doc_id, lang, th and text go through as they are."""
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    for batch in batches:
        more = [c for c in batch.schema.names if c not in ("doc_id", "lang", "th", "text")]
        # A whole row has its text in the struct alone.
        given = batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")
        for lo, hi, columns in _counted(strings(given)):
            before, behind = ([batch.column(c).slice(lo, hi - lo) for c in cs] for cs in (("doc_id", "lang", "th"), more))
            yield pa.RecordBatch.from_arrays([*before, *columns, *behind], names=[*names, *more])


def base_failed(words: Column, repeated: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeated > 50 * words)


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """For each row of docs its counts and histograms (_FEATURES; th: a hash of its text) and base_failed; whole: also the row itself, as the struct row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("th"), F.struct("*").alias("row") if whole else text.alias("text"))
    schema = T.StructType([*T.StructType.fromDDL(_FEATURES), *[f for f in rows.schema if f.name == "row"]])
    return in_arrow(rows, _features, schema).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def _shares(counts: str) -> Column:
    """Of column classes or common; their sums are n_chars and n_words."""
    total = F.greatest(F.col({"classes": "n_chars", "common": "n_words"}[counts]), F.lit(1)).cast("double")
    return F.transform(counts, lambda x: x / total)


def references(found: DataFrame) -> DataFrame:
    """lang (null: all documents), ref_classes, ref_common: means over the distinct texts that pass the base rules."""
    once = found.filter(~F.col("base_failed")).dropDuplicates(["lang", "th"])
    shares = once.select("lang", F.concat(_shares("classes"), _shares("common")).alias("shares"))
    # Of the many bins most are empty: sums and the number of documents give the means.
    sums = shares.select("lang", F.posexplode("shares").alias("bin", "share")).filter("share > 0").groupBy("lang", "bin").agg(F.sum("share").alias("sum"))
    n = shares.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    both = lambda df, keys, value: df.filter("lang IS NOT NULL").unionByName(df.groupBy(*keys).agg(F.sum(value).alias(value)).withColumn("lang", F.lit(None).cast("string")))
    sums, n = both(sums, ["bin"], "sum"), both(n, [], "n").filter("n > 0")
    means = sums.join(n.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of"))).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col("sum") / F.col("n")))).alias("mean"))
    at = lambda lo, hi: F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda i: F.coalesce(F.element_at("mean", i), F.lit(0.0)))
    return means.select("lang", at(0, len(CLASSES)).alias("ref_classes"), at(len(CLASSES), len(CLASSES) + len(COMMON) + 1).alias("ref_common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two lists of shares, 0 to 1."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _judged(found: DataFrame, refs: DataFrame) -> DataFrame:
    both = F.struct("ref_classes", "ref_common")
    of_all, own = refs.filter("lang IS NULL").select(F.array(both).alias("_all")), refs.filter("lang IS NOT NULL")
    every = own.agg(F.collect_list(both).alias("_each")).join(F.broadcast(of_all), F.lit(True), "left").select(F.when(F.size("_each") > 0, F.col("_each")).otherwise(F.col("_all")).alias("_every"))
    # One row at most, so this is no product of two tables; it goes to the rows without a reference of their own.
    joined = found.join(small(own.select("lang", F.array(both).alias("_own"))), "lang", "left").join(F.broadcast(every), F.col("_own").isNull(), "left")
    ok = lambda d, n, least, limit, spread: (F.col(n) < least) | (d <= limit + spread / F.sqrt(F.greatest(F.col(n), F.lit(1))))

    def held(ref: Column) -> Column:
        classes, common = distance(_shares("classes"), ref["ref_classes"]), distance(_shares("common"), ref["ref_common"])
        return F.struct(classes.alias("class_distance"), common.alias("common_distance"))

    def verdict(d: Column) -> Column:
        near = ok(d["class_distance"], "n_chars", MIN_CHARS, CLASS_LIMIT, CLASS_SPREAD) & ok(d["common_distance"], "n_words", MIN_COMMON, COMMON_LIMIT, COMMON_SPREAD)
        return F.struct((~near).alias("far"), d["common_distance"].alias("common_distance"), d["class_distance"].alias("class_distance"))

    # A reference that it is near, if there is one, and the nearest by common words.
    best = F.array_min(F.transform(F.transform(F.coalesce("_own", "_every"), held), verdict))
    measured = joined.withColumn("_best", best).select(*found.columns, "_best.class_distance", "_best.common_distance", "_best.far")
    return measured.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("far", F.lit(False))).drop("far")


def judge(docs: DataFrame) -> DataFrame:
    """For each row of docs: its features, class_distance, common_distance, kept."""
    found = Stored(features(docs), "features").df
    return _judged(found, Stored(references(found), "references").df)


def good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Rows are written once with their features, and read again for the verdict."""
    found = Stored(features(docs, whole=True), "features", batch_bytes=BATCH_BYTES).df
    refs = Stored(references(found.drop("row")), "references").df
    return _judged(found, refs).filter("kept").select("row.*")
