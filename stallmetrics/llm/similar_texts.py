r"""Near copies of a given similarity by SimHash fingerprints of 128 bits and multi-index hashing.

Texts that share 0.8 of their five-word shingles (Jaccard) differ in about a seventh of a fingerprint's
bits. With 64 bits that is too rough a measure: chance alone brings many pairs of a large corpus as near.
So the fingerprint has 128 bits, from the 128-bit XXH3 of each shingle; words, lower-casing and the rule
for a bit are as in simhash.py. Shingle sets of equal size with similarity s stand at an angle whose cosine
is 2s / (1 + s), and fingerprints differ in angle / pi of their bits on average; radius() goes SPREAD
standard deviations beyond that, 26 bits for 0.8, so that few such pairs are farther apart.

Of the 128 bits 126 are cut into 7 segments of 18 bits. A fingerprint is filed under each value within one
bit of its segment, so two fingerprints meet if a segment of theirs differs in two bits or fewer: that is
sure up to 20 differing bits, and of the pairs at 0.8 it is true of 99 in 100. Complete distances are verified
in the bucket. A bucket gives links that connect what its links connect, never all pairs of a large one.
Values that many fingerprints share could fill a bucket; those buckets are divided by further bits, of which
two linked fingerprints always have a part in common, until they are small.

A link of fingerprints is a candidate: verified() reads both texts and keeps it only if their similarity, exactly,
is as large as asked.

Fingerprints miss a few such pairs: those that differ in more bits than the radius, that meet in no segment, or whose
link stands behind one that fails. If the exact result is asked for, only the links that were found most often are verified
of each text, and missed() holds the texts that are in different components then against each other, by the shingles
that two texts so similar must share (prefix filtering) and by bounds of their similarity; no link is lost.

Cases: as in simhash.py. A fingerprint's vertex in the component table is its 64-bit hash. Texts of one
fingerprint count as copies.
"""

from __future__ import annotations

import itertools
import math
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, in_arrow, keyed, small
from .components import components
from .simhash import LOW, NO_ID
from .words import Words, split_words, strings

SHINGLE, SIMILARITY = 5, 0.8
BITS = 128
#: Standard deviations of the differing bits by which the radius is larger than their mean.
SPREAD = 1.75
#: Fingerprints that a task may hold of one bucket (16 bytes each).
BUCKET = 100_000
#: Links of fingerprints that are verified of each text, if the exact step follows.
NEAREST = 4
#: Bits by which texts are told apart before they are read (a power of two).
MARKS = 1024
#: Groups up to SCANNED fingerprints are compared pair by pair; those and larger ones give a spanning forest if they have more links than PAIRED for each fingerprint.
SCANNED, PAIRED = 64, 2


def radius(similarity: float) -> int:
    """Differing bits up to which fingerprints may be those of texts with this similarity."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(BITS * p + SPREAD * math.sqrt(BITS * p * (1 - p)))


def _bits(digests: list[bytes]) -> bytes:
    """Bit i is 1 if it is set in over half of the digests."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(digests), 16_384):
        part = np.frombuffer(b"".join(digests[i : i + 16_384]), np.uint8).reshape(-1, BITS // 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(digests)).tobytes()


def _fingerprints(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        out = [bytes(BITS // 8)] * len(batch)
        for words in split_words(strings(batch.column("text"))):
            raw, length = LOW[words.data].tobytes(), words.end - words.start
            joined = b" ".join([raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
            end = np.cumsum(length + 1) - 1
            start = end - length
            for i in range(words.hi - words.lo):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                if hi > lo:
                    n = min(k, hi - lo)
                    out[words.lo + i] = _bits([digest(joined[x:y]) for x, y in zip(start[lo : hi - n + 1].tolist(), end[lo + n - 1 : hi].tolist(), strict=True)])
        both = np.frombuffer(b"".join(out), ">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "th", "fa", "fb"])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (see keyed), fa, fb (the first and the last 64 bits) for each row."""
    return in_arrow(keyed(docs), lambda b: _fingerprints(words_per_shingle, b), "doc_id long, th long, fa long, fb long")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(a ^ b)
    return bits[..., 0] + bits[..., 1]


def _forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links from each fingerprint of a component but one to another of it.

    They go to the fingerprint nearest to the majority of the bits, which is about that of the text that the others were
    made from: copies may be less alike to each other than to that. Then on from those, the nearest first.
    """
    out: list[tuple[int, int]] = []
    left, centred = np.arange(len(fps)), True
    while len(left) > 1:
        before, k = len(left), 0
        if centred:
            ones = np.zeros(BITS, np.int64)
            for i in range(0, len(left), 16_384):
                ones += np.unpackbits(fps[left[i : i + 16_384]].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
            centre = np.packbits(2 * ones > len(left)).view(np.uint64)
            k = int(_apart(fps[left], centre).argmin())
        queue, left = deque([int(left[k])]), np.delete(left, k) if k else left[1:]
        while queue and len(left):
            at = queue.popleft()
            apart = _apart(fps[left], fps[at])
            near = apart <= most
            if not near.any():
                continue
            found = left[near][np.argsort(apart[near], kind="stable")].tolist()
            out += [(x, at) for x in found]
            queue += found
            left = left[~near]
        # What is left has a centre only if the last component was no small part; else most have no link at all.
        centred = 16 * (before - len(left)) >= before
    return out


def _pairs(most: int, key: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Edges (fa, fb, ga, gb) of whole groups of equal keys, which stand together."""
    cut = np.flatnonzero(np.diff(key)) + 1
    first = np.r_[0, cut]
    size = np.diff(np.r_[first, len(key)])
    of = np.repeat(np.arange(len(size)), size)
    scanned = size[of] <= SCANNED
    place = np.arange(len(key)) - first[of]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.flatnonzero(scanned)
    for d in range(1, SCANNED):
        rows = rows[place[rows] + d < size[of[rows]]]
        near = rows[_apart(fps[rows], fps[rows + d]) <= most]
        a.append(near)
        b.append(near + d)
    a, b = np.concatenate(a), np.concatenate(b)
    links = np.bincount(of[a], minlength=len(size)) if len(size) else np.zeros(0, np.int64)
    dense = (size > SCANNED) | (links > PAIRED * size)
    keep = ~dense[of[a]]
    a, b = [a[keep]], [b[keep]]
    for g in np.flatnonzero(dense):
        found = np.array(_forest(fps[first[g] : first[g] + size[g]], most), np.int64).reshape(-1, 2) + first[g]
        a.append(found[:, 0])
        b.append(found[:, 1])
    return np.unique(np.concatenate([fps[np.concatenate(a)], fps[np.concatenate(b)]], axis=1).view(np.int64), axis=0)


def _edges(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: sorted by key. The last key of a batch waits for the next, as its group may go on."""
    key, fps = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    for batch in itertools.chain(batches, [None]):
        whole = len(key)
        if batch is not None:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, np.stack([batch.column(c).to_numpy() for c in ("fa", "fb")], axis=1).view(np.uint64)])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if whole:
            pairs = _pairs(most, key[:whole], fps[:whole])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(4)], names=["fa", "fb", "ga", "gb"])
            key, fps = key[whole:], fps[whole:]


class Segment(NamedTuple):
    """Bits of fa and fb that are one value: a number of bits from a place on, of each."""

    fa: int
    fa_bits: int
    fb: int
    fb_bits: int

    def value(self) -> Column:
        part = lambda c, at, n: F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << n) - 1))
        return F.shiftleft(part("fa", self.fa, self.fa_bits), self.fb_bits).bitwiseOR(part("fb", self.fb, self.fb_bits))

    def mask(self) -> int:
        """In the 128 bits, fa above fb."""
        return ((1 << self.fa_bits) - 1) << self.fa + 64 | ((1 << self.fb_bits) - 1) << self.fb


WIDTH = 18
SEGMENTS = (*[Segment(i * WIDTH, WIDTH, 0, 0) for i in range(3)], *[Segment(0, 0, i * WIDTH, WIDTH) for i in range(3)], Segment(3 * WIDTH, WIDTH // 2, 3 * WIDTH, WIDTH // 2))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def vertex(fa: str, fb: str) -> Column:
    return F.xxhash64(fa, fb)


def links(distinct: DataFrame, most: int, bucket: int = BUCKET) -> DataFrame:
    """a, b (vertices): edges that connect what links of distinct (fa, fb), at `most` or fewer differing bits, connect."""
    spark = distinct.sparkSession
    owned = distinct.select("fa", "fb", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), x.value().alias("own")) for i, x in enumerate(SEGMENTS)])).alias("s")).select("fa", "fb", "s.*")
    ball = F.array(*[F.lit(x).cast("long") for x in (0, *[1 << i for i in range(WIDTH)])])
    around = lambda df: df.withColumn("flip", F.explode(ball)).withColumn("value", F.col("own").bitwiseXOR(F.col("flip"))).drop("own", "flip")
    # A bucket has the fingerprints of the values around it, so it is small unless one of these has many.
    crowded = Stored(owned.groupBy("seg", "own").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * (WIDTH + 1) > bucket).drop("n"), "crowded")
    full = small(around(crowded.df).distinct())
    probes = around(owned).select("seg", "value", "fa", "fb")

    def found(groups: DataFrame, key: list[str]) -> DataFrame:
        # Rows of a bucket stand together in a sorted partition, so that no list of them is built. Keys that share a hash only add candidates.
        one = F.shiftleft(F.col("seg").cast("long"), 40).bitwiseOR(F.col("value")) if key == ["seg", "value"] else F.xxhash64(*key)
        placed = groups.select(one.alias("key"), "fa", "fb").repartition("key").sortWithinPartitions("key")
        edges = in_arrow(placed, lambda b: _edges(most, b), "fa long, fb long, ga long, gb long")
        return Stored(edges.select(vertex("fa", "fb").alias("a"), vertex("ga", "gb").alias("b")), "links").df

    if crowded.df.isEmpty():
        crowded.drop()
        return found(probes, ["seg", "value"])
    edges = found(probes.join(full, ["seg", "value"], "left_anti"), ["seg", "value"])
    rest = Stored(probes.join(full, ["seg", "value"]).select("seg", "value", F.lit(0).cast("long").alias("ma"), F.lit(0).cast("long").alias("mb"), F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"), "fa", "fb"), "buckets")
    key, masks = ["seg", "value", "ma", "mb", "pa", "pb"], {(i, 0) for i in range(len(SEGMENTS))}
    while True:
        sizes = rest.df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = rest.df.hint("merge").join(sizes, key)
        taken = {(s, m): m | SEGMENTS[s].mask() for s, m in masks}
        last = all(BITS - m.bit_count() <= most for m in taken.values())
        edges = edges.unionByName(found(sized if last else sized.filter(F.col("size") <= bucket), key))
        large = sized.filter(F.col("size") > bucket).drop("size")
        if last or large.isEmpty():
            rest.drop()
            crowded.drop()
            return edges
        steps, finer = [], set()
        for (s, m), t in taken.items():
            free = [i for i in range(BITS) if not t >> i & 1]
            for i in range(most + 1):
                part = sum(1 << x for x in free[len(free) * i // (most + 1) : len(free) * (i + 1) // (most + 1)])
                if part:
                    finer.add((s, m | part))
                    steps.append((s, *[_signed(x >> n & (1 << 64) - 1) for x in (m, m | part) for n in (64, 0)]))
        by = F.broadcast(spark.createDataFrame(steps, "seg int, ma long, mb long, na long, nb long"))
        deeper = Stored(large.drop("pa", "pb").join(by, ["seg", "ma", "mb"]).select("seg", "value", F.col("na").alias("ma"), F.col("nb").alias("mb"), F.col("fa").bitwiseAND(F.col("na")).alias("pa"), F.col("fb").bitwiseAND(F.col("nb")).alias("pb"), "fa", "fb"), "buckets")
        rest.drop()
        rest, masks = deeper, finer


def _sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each row, as hashes; a row of fewer words has one, of all of them."""
    hashes = words.hashes()
    for i in range(words.hi - words.lo):
        lo, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
        yield np.unique(words.windows(hashes, np.arange(lo, lo + max(1, n - k + 1)) if n else np.zeros(0, np.int64), min(k, n))) if n else np.zeros(0, np.uint64)


def _alike(k: int, similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A text that many edges of a batch have is read once.
        said = pa.concat_arrays([strings(batch.column("ta")), strings(batch.column("tb"))]).dictionary_encode()
        column, at = said.dictionary, said.indices.to_numpy()
        data = pa.Array.from_buffers(pa.string(), len(column), [None, column.buffers()[1], pa.py_buffer(LOW[np.frombuffer(column.buffers()[2] or b"", np.uint8)])], offset=column.offset)
        sets = [x for words in split_words(data) for x in _sets(words, k)]
        keep = []
        for i, j in zip(at[: len(batch)].tolist(), at[len(batch) :].tolist(), strict=True):
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            keep.append(shared >= similarity * (len(sets[i]) + len(sets[j]) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(edges: DataFrame, texts: DataFrame, words_per_shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The edges (a, b) whose texts (v, text) have at least that similarity of their shingle sets. An edge takes both its texts along."""
    of = lambda v, t: texts.select(F.col("v").alias(v), F.col("text").alias(t))
    both = edges.select("a", "b").distinct().join(of("a", "ta"), "a").join(of("b", "tb"), "b").select("a", "b", "ta", "tb")
    return in_arrow(both, lambda b: _alike(words_per_shingle, similarity, b), "a long, b long")


def _lower_sets(k: int, texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text."""
    column = strings(texts)
    data = pa.Array.from_buffers(pa.string(), len(column), [None, column.buffers()[1], pa.py_buffer(LOW[np.frombuffer(column.buffers()[2] or b"", np.uint8)])], offset=column.offset)
    for words in split_words(data):
        yield from _sets(words, k)


def _lack(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """So many of its n shingles a text may lack of another one that is alike."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64)


def _spread(k: int, similarity: float, below: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t, v, root, sizes: a row for each shingle of a text up to a hash; sizes has how many the text has, and how many of these up to the hash (32 bits each).

    A text with so few of these that it may lack them all has its v as one more, so that it is known.
    """
    for batch in batches:
        rows, parts, sizes = [], [], []
        own = batch.column("v").to_numpy().view(np.uint64)
        for row, found in enumerate(_lower_sets(k, batch.column("text"))):
            if n := len(found):
                low = found[: np.searchsorted(found, np.uint64(below), "right")]
                rows.append(row)
                parts.append(low if len(low) > _lack(n, similarity) else np.r_[low, own[row]])
                sizes.append(n << 32 | len(low))
        if rows:
            many = [len(x) for x in parts]
            of = pa.array(np.repeat(rows, many))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), batch.column("v").take(of), batch.column("root").take(of), pa.array(np.repeat(sizes, many))], names=["t", "v", "root", "sizes"])


def _shared(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: rows of _spread(), sorted by t. Those whose t texts of two or more roots have stay, and those of texts that may lack all; c: the rows of the same t.

    The last t of a batch waits for the next, as its group may go on.
    """
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        ready = held
        if batch is not None:
            t = batch.column("t").to_numpy()
            if not len(t) or held and held[0].column("t")[0].as_py() == t[0] == t[-1]:
                held += [batch] if len(t) else []
                continue
            whole = int(np.searchsorted(t, t[-1]))
            ready, held = [*held, batch.slice(0, whole)], [batch.slice(whole)]
        if not sum(map(len, ready)):
            continue
        rows = pa.Table.from_batches(ready).combine_chunks()
        t, root, sizes = (rows.column(c).to_numpy() for c in ("t", "root", "sizes"))
        first = np.r_[0, np.flatnonzero(np.diff(t)) + 1]
        size = np.diff(np.r_[first, len(t)])
        mixed = np.repeat(np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first), size)
        keep = mixed | ((sizes & (1 << 32) - 1) <= _lack(sizes >> 32, similarity))
        yield from rows.append_column("c", pa.array(np.repeat(size, size))).filter(pa.array(keep)).to_batches(max_chunksize=65_536)


def _firsts(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches: rows of _shared(), sorted by v, c, t. Of each text the first shingles in the order, those that only its root has being before all (own: how many): one more than it may lack.

    bits: of MARKS bits those that an odd number of the text's shared shingles fall on. Texts differ in as many shared shingles as in bits, or in more.
    """
    names = ("t", "v", "root", "sizes")
    held = [np.zeros(0, np.int64)] * 4
    for batch in itertools.chain(batches, [None]):
        whole = len(held[1])
        if batch is not None:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, names, strict=True)]
            whole = int(np.searchsorted(held[1], held[1][-1])) if len(held[1]) else 0
        if not whole:
            continue
        t, v, root, sizes = (x[:whole] for x in held)
        held = [x[whole:] for x in held]
        first = np.r_[0, np.flatnonzero(np.diff(v)) + 1]
        m, n = np.diff(np.r_[first, whole]), sizes[first] >> 32
        of = np.repeat(np.arange(len(m)), m)
        odd = np.zeros((len(m), MARKS), np.uint8)
        np.bitwise_xor.at(odd, (of, ((t.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MARKS.bit_length() + 1)).astype(np.int64)), 1)
        bits = np.packbits(odd, axis=1)
        i = (n - m)[of] + np.arange(whole) - first[of]
        keep = np.flatnonzero(i <= _lack(n, similarity)[of])
        if len(keep):
            at = of[keep]
            column = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(v[keep]), pa.array(root[keep]), column(n[at]), column(i[keep]), column((n - m)[at]), pa.array([x.tobytes() for x in bits], pa.binary()).take(pa.array(at))], names=["t", "v", "root", "n", "i", "own", "bits"])


def _met(similarity: float, t: np.ndarray, v: np.ndarray, root: np.ndarray, n: np.ndarray, i: np.ndarray, own: np.ndarray | None = None, bits: np.ndarray | None = None, probe: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts of different components that share a shingle of their prefixes and may be alike, by their sizes and the shingle's places. Groups of equal t stand together, sorted by n.

    probe: of each row one pair.
    """

    def able(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        few, most = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        fit = (root[a] != root[b]) & (few >= similarity * most - 1e-9) & (np.minimum(n[a] - i[a], n[b] - i[b]) >= similarity / (1 + similarity) * (few + most) - 1e-9)
        if bits is not None and fit.any():
            # Shingles that only one of the two has: those that only its root has, and shared ones.
            x, y = a[fit], b[fit] if isinstance(b, np.ndarray) else b
            fit[fit] = own[x] + own[y] + np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * (few + most)[fit] + 1e-9
        return fit

    first = np.r_[0, np.flatnonzero(np.diff(t)) + 1]
    size = np.diff(np.r_[first, len(t)])
    mixed = np.repeat(np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first), size)
    if not mixed.any():
        return
    t, v, root, n, i, own, bits = (x if x is None else x[mixed] for x in (t, v, root, n, i, own, bits))
    first = np.r_[0, np.flatnonzero(np.diff(t)) + 1]
    size = np.diff(np.r_[first, len(t)])
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(t)) - first[of]
    rows = np.flatnonzero(size[of] <= SCANNED)
    for d in range(1, SCANNED):
        rows = rows[place[rows] + d < size[of[rows]]]
        fit = able(rows, rows + d)
        near = rows[fit]
        yield v[near], v[near + d]
        if probe:
            rows = rows[~fit]
    for g in np.flatnonzero(size > SCANNED):
        all_ = np.arange(first[g], first[g] + size[g])
        roots, count = np.unique(root[all_], return_counts=True)
        main = roots[count.argmax()]
        for x in all_[root[all_] != main]:
            lo, hi = np.searchsorted(n[all_], [similarity * n[x] - 1e-9, n[x] / similarity + 1e-9])
            y = all_[lo:hi]
            y = y[(root[y] == main) | (y > x)]
            y = y[able(y, int(x))][: 1 if probe else None]
            if len(y):
                yield np.full(len(y), v[x]), v[y]


def _candidates(similarity: float, batches: Iterator[pa.RecordBatch], probe: bool = False) -> Iterator[pa.RecordBatch]:
    """batches: sorted by t, n. The last t of a batch waits for the next, as its group may go on."""
    names = ("t", "v", "root", "n", "i", "own")
    held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)] * 3 + [np.zeros((0, MARKS // 64), np.uint64)]
    for batch in itertools.chain(batches, [None]):
        whole = len(held[0])
        if batch is not None:
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, MARKS // 64)
            held = [np.concatenate([x, y]) for x, y in zip(held, [*[batch.column(c).to_numpy() for c in names], bits], strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if whole:
            for a, b in _met(similarity, *[x[:whole] for x in held], probe):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            held = [x[whole:] for x in held]


SHARED = "t long, v long, root long, sizes long, c long"


def _shared_with_others(texts: DataFrame, roots: DataFrame, below: int, k: int, similarity: float) -> DataFrame:
    """Rows of _shared(); roots: v, root, without one a text is its own."""
    rooted = texts.join(small(roots), "v", "left").select("v", F.coalesce("root", "v").alias("root"), "text")
    rows = in_arrow(rooted, lambda b: _spread(k, similarity, below, b), "t long, v long, root long, sizes long")
    return in_arrow(rows.repartition("t").sortWithinPartitions("t"), lambda b: _shared(similarity, b), SHARED)


def open_texts(texts: DataFrame, roots: DataFrame, words_per_shingle: int = SHINGLE, similarity: float = SIMILARITY) -> Stored:
    """The texts (v, text) that may be alike to one of another root.

    A shingle that only texts of one root have is shared with no text of another. A text with more of these than it may
    lack is alike to none. Half of all hashes tell that of most texts.
    """
    n, low = F.shiftright("sizes", 32), F.col("sizes").bitwiseAND((1 << 32) - 1)
    shared = _shared_with_others(texts, roots, (1 << 63) - 1, words_per_shingle, similarity).groupBy("v", "sizes").agg(F.count(F.lit(1)).alias("m"))
    living = Stored(shared.filter(low - F.col("m") <= n - F.ceil(similarity * n - 1e-9)).select("v"), "living")
    left = Stored(texts.join(small(living.df), "v", "left_semi"), "open")
    living.drop()
    return left


def missed(texts: DataFrame, roots: DataFrame, words_per_shingle: int = SHINGLE, similarity: float = SIMILARITY, probe: bool = False) -> Stored:
    """a, b: all pairs of texts (v, text) that may be that similar and have different roots (v, root; without one: itself); none that is gets lost.

    Shingles stand in one order for all texts: those that only texts of one root have first, then those that fewest texts
    have. Two texts that are alike share one of their first shingles: those that remain when the least number that
    they have to share, less one, is taken off the end. Of pairs that do, the marks tell most that can't be alike.

    probe: only some of the pairs, no more than there are such first shingles.
    """
    shared = _shared_with_others(texts, roots, (1 << 64) - 1, words_per_shingle, similarity)
    firsts = in_arrow(shared.repartition("v").sortWithinPartitions("v", "c", "t"), lambda b: _firsts(similarity, b), "t long, v long, root long, n int, i int, own int, bits binary")
    pairs = in_arrow(firsts.repartition("t").sortWithinPartitions("t", "n"), lambda b: _candidates(similarity, b, probe), "a long, b long")
    return Stored(pairs.distinct(), "rest")


def nearest(met: DataFrame) -> DataFrame:
    """Of the links (a, b, n: how often they were found) of each text the NEAREST found most often: near fingerprints meet in most buckets."""
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    best = both.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).filter(F.col("_r") <= NEAREST)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_of_each(docs: DataFrame, words_per_shingle: int = SHINGLE, similarity: float = SIMILARITY, bucket: int = BUCKET, exact: bool = False) -> DataFrame:
    """The rows of docs that stay, with all columns: of each component one with the smallest doc_id (a null one only if all are null).

    exact: with the links that the fingerprints miss, see missed().
    """
    rows = Stored(fingerprints(docs, words_per_shingle), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_i"), F.col("th").alias("_t"))
    # Map-side combining first: copies of one text are one row from here on.
    distinct = Stored(rows.df.groupBy("fa", "fb").agg(F.min(key).alias("key")).withColumn("v", vertex("fa", "fb")), "distinct")
    rows.drop()
    met = links(distinct.df.select("fa", "fb"), radius(similarity), bucket).filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # The exact step finds whatever else holds.
    met = Stored(nearest(Stored(met, "links-met").df) if exact else met.drop("n"), "candidates")
    # One text for each fingerprint that has a link; for the exact step for each.
    wanted = distinct.df
    if not exact:
        wanted = wanted.join(met.df.select(F.col("a").alias("v")).union(met.df.select("b")).distinct(), "v", "left_semi")
    said = keyed(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_i"), F.col("th").alias("_t"), "text")
    texts = Stored(said.join(small(wanted.select("v", "key._i", "key._t")), ["_i", "_t"]).select("v", "text").dropDuplicates(["v"]), "texts")
    near = Stored(verified(met.df, texts.df, words_per_shingle, similarity), "near")
    roots, done = components(near.df), [distinct, met, texts, near]
    if exact:
        # Texts of a large group are alike in many pairs; a few of these join it before all that are left are looked at.
        left, held = open_texts(texts.df, roots, words_per_shingle, similarity), near.df
        done.append(left)
        for probe in (True, False):
            rest = missed(left.df, roots, words_per_shingle, similarity, probe)
            found = Stored(verified(rest.df, left.df, words_per_shingle, similarity), "near")
            rest.drop()
            held = held.unionByName(found.df)
            roots = components(held)
            done.append(found)
    labelled = distinct.df.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    stay = Stored(labelled.groupBy("root").agg(F.min("key").alias("key")).select("key._i", "key._t"), "stay")
    for table in done:
        table.drop()
    whole = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_i"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_t"))
    once = Window.partitionBy("_i", "_t").orderBy("_i")
    return whole.join(small(stay.df), ["_i", "_t"]).withColumn("_row", F.row_number().over(once)).filter("_row = 1").select("_doc.*")
