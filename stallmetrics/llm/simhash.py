r"""SimHash fingerprints and near duplicates by multi-index hashing.

Fingerprint: A-Z of the text lower-cased, words `[^\x20\x09-\x0D]+`, shingles of `words_per_shingle`
words joined by a blank (a text of fewer words: all of them; none: fingerprint zero), repeats
included; bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Links: fingerprints at `RADIUS` = 3 or fewer differing bits. Equal fingerprints are one vertex.
Of two fingerprints that link, one 32-bit half differs in one bit at most. So each fingerprint is
filed under its two halves, looks up the Hamming ball of radius 1 around each half (33 values), and
meets its partners in the bucket of a half. Complete distances are verified inside the bucket,
which then gives a spanning forest of its links, never all its pairs.

A bucket of over `BUCKET` fingerprints is divided: its members can differ in three bits of the other
half at most, so of any four parts of that half's bits one is equal. The bucket is filed anew under
each part, again and again if need be, on ever fewer free bits, until it is small. That bounds what a
task holds, loses no link and drops nothing.

Components come from contraction over written tables (components.py).

Cases: null text is like empty text; repeated rows share a fingerprint and so a component; a null
doc_id is no component's id unless all ids are null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, in_arrow, keyed
from .components import components
from .words import split_words, strings

SHINGLE = 3
SEED = 42
RADIUS = 3
BUCKET = 4096
#: Stands for a null doc_id where rows are told apart.
NO_ID = -(1 << 63)

LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


def _fingerprint(shingles: list[bytes]) -> int:
    if not shingles:
        return 0
    digest = xxhash.xxh64_intdigest
    counts = _bit_counts(np.array([digest(s, SEED) for s in shingles], np.uint64))
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def _fingerprints(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(len(batch), np.uint64)
        for words in split_words(strings(batch.column("text"))):
            data = LOW[words.data]
            # Words one blank apart, for whole chunks: a shingle is then one slice.
            raw, length = data.tobytes(), words.end - words.start
            joined = b" ".join([raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
            end = np.cumsum(length + 1) - 1
            start = end - length
            for i in range(words.hi - words.lo):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                if hi > lo:
                    n = min(k, hi - lo)
                    a, b = start[lo : hi - n + 1].tolist(), end[lo + n - 1 : hi].tolist()
                    out[words.lo + i] = _fingerprint([joined[x:y] for x, y in zip(a, b, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(out.view(np.int64))], names=["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (see keyed), fp (the 64 bits as a long) for each row."""
    return in_arrow(keyed(docs), lambda b: _fingerprints(words_per_shingle, b), "doc_id long, th long, fp long")


def scatter(fp):
    """A bijection of longs that breaks their order (xorshift); for a column or a numpy array of uint64."""
    if isinstance(fp, np.ndarray):
        for n, left in ((13, True), (7, False), (17, True)):
            fp = fp ^ (fp << np.uint64(n) if left else fp >> np.uint64(n))
        return fp
    for n, shift in ((13, F.shiftleft), (7, F.shiftrightunsigned), (17, F.shiftleft)):
        fp = fp.bitwiseXOR(shift(fp, n))
    return fp


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each fingerprint that links to the first of its component; distances are verified on all 64 bits."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left) > 1:
        first, queue, left = int(left[0]), [int(left[0])], left[1:]
        while queue and len(left):
            near = np.bitwise_count(fps[left] ^ fps[queue.pop()]) <= RADIUS
            found = left[near].tolist()
            out += [(x, first) for x in found]
            queue += found
            left = left[~near]
    return out


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for members in batch.column("members"):
            fps = np.unique(members.values.to_numpy().view(np.uint64))
            edges = np.array(_forest(fps), np.int64).reshape(-1, 2)
            names = scatter(fps).view(np.int64)
            a.append(names[edges[:, 0]])
            b.append(names[edges[:, 1]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _parts(free: tuple[int, ...]) -> list[tuple[int, ...]]:
    return [p for i in range(4) if (p := free[len(free) * i // 4 : len(free) * (i + 1) // 4])]


def _mask(bits: tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def _finer(buckets: DataFrame, fixed: set[int]) -> tuple[DataFrame, set[int]]:
    """The same rows filed under one more part of the other half's free bits. fixed: the masks of bits fixed so far."""
    rows, masks = [], set()
    for mask in fixed:
        for part in _parts(tuple(b for b in range(32) if not mask >> b & 1)):
            rows.append((mask, mask | _mask(part)))
            masks.add(mask | _mask(part))
    steps = F.broadcast(buckets.sparkSession.createDataFrame(rows, "fixed long, finer long"))
    finer = buckets.drop("part").join(steps, "fixed").select("half", "value", F.col("finer").alias("fixed"), F.col("other").bitwiseAND(F.col("finer")).alias("part"), "other", "fp")
    return finer, masks


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b (scattered fingerprints): edges that connect exactly what links of distinct (fp) connect."""
    low = (1 << 32) - 1
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(low).alias("own"), F.shiftrightunsigned("fp", 32).alias("other")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("own"), F.col("fp").bitwiseAND(low).alias("other")),
    )
    owned = distinct.select("fp", F.explode(halves).alias("h")).select("fp", "h.*")
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    probes = owned.withColumn("flip", F.explode(ball)).select("half", F.col("own").bitwiseXOR(F.col("flip")).alias("value"), "other", "fp")
    filed = owned.groupBy("half", F.col("own").alias("value")).agg(F.count(F.lit(1)).alias("owners"))
    # Spark doesn't foresee how many rows the ball makes, so it could take probes for small enough to broadcast.
    met = Stored(probes.hint("merge").join(filed, ["half", "value"]).select("half", "value", F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("part"), "other", "fp"), "buckets")
    key, fixed, edges = ["half", "value", "fixed", "part"], {0}, None
    while True:
        sizes = met.df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = met.df.hint("merge").join(sizes, key)
        # At 2**4 free values and 33 lookups each a bucket cannot be divided further, and is small.
        last = all(32 - bin(m).count("1") <= 4 for m in fixed)
        groups = sized if last else sized.filter(F.col("size") <= bucket)
        found = Stored(groups.groupBy(key).agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(_bucket_edges, "a long, b long"), "links").df
        edges = found if edges is None else edges.unionByName(found)
        large = sized.filter(F.col("size") > bucket).drop("size")
        if last or large.isEmpty():
            met.drop()
            return edges
        finer, fixed = _finer(large, fixed)
        finer = Stored(finer, "buckets")
        met.drop()
        met = finer


def _classes(docs: DataFrame, words_per_shingle: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Rows of fingerprints(); for each fp its component's root and the component's smallest doc_id."""
    rows = Stored(fingerprints(docs, words_per_shingle), "fingerprints").df
    distinct = Stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct").df
    roots = components(links(distinct.select("fp"), bucket))
    labelled = distinct.withColumn("v", scatter(F.col("fp"))).join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, labelled.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id for each row; component_id is the smallest doc_id that links reach."""
    rows, classes = _classes(docs, words_per_shingle, bucket)
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words_per_shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs that stay, with all columns: of each component one with the smallest doc_id (a null one only if all are null)."""
    rows, classes = _classes(docs, words_per_shingle, bucket)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_i"), F.col("th").alias("_t"))
    stay = Stored(rows.join(classes, "fp").groupBy("root").agg(F.min(key).alias("key")).select("key._i", "key._t"), "stay").df
    whole = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_i"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_t"))
    once = Window.partitionBy("_i", "_t").orderBy("_i")
    return whole.join(stay, ["_i", "_t"]).withColumn("_row", F.row_number().over(once)).filter("_row = 1").select("_doc.*")
