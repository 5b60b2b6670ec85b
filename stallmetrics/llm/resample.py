r"""Importance resampling towards a target distribution, by hashed n-grams; DataFrame functions only.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased. A document's features are its
runs of 1 to `longest` consecutive words, repeats counted; a feature's bucket is the unsigned crc32 of its
UTF-8 bytes modulo `buckets`. A bucket's gain is how much likelier it is in the target than in the documents,
add-one smoothed, in thousandths of a nat, floored. A document's weight is the floored mean of its features'
gains, and its score is the weight plus Gumbel noise of its doc_id: the highest scores are a draw without
replacement by weight.

Features are exploded and counted by bucket, with partial sums in each task; the table of gains has `buckets`
rows, which bounds its broadcast. Sums by document need no more than a row for each document and task. Ranks
come from a distributed sort: rows are sorted by ranges and written with their partition and place in it, and
a partition's offset is the sum of the sizes before it; no row goes to one place.

Cases: null or empty text, and text without words, has no features, weight 0, and is not drawn (fewer than
`least` words); rows that repeat a doc_id are documents of their own if their texts differ, and equal rows
each get a rank (ties by doc_id, then by a hash of the text); the noise of a null doc_id is that of the text
"null" and it ranks before others; an empty table gives no rows; an empty target gives gains of the smoothed
zero counts; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, keyed

BUCKETS, LONGEST, LEAST, SEED, PERCENT = 10_000, 2, 20, 7, 25
#: How many values of monotonically_increasing_id() a partition has.
_PLACES = 33

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, th, at (a word's place), n (words in the feature), bucket; for a document without words one row whose at, n and bucket are null. docs: see keyed()."""
    # A name of its own keeps the array apart from any column of docs.
    own = f"_w{uuid.uuid4().hex}"
    places = docs.select("doc_id", "th", words(F.col("text")).alias(own)).select("doc_id", "th", own, F.posexplode_outer(own).alias("at", "word"))
    grams, gram = [], F.col("word")
    for n in range(1, longest + 1):
        if n > 1:
            gram = F.concat(gram, F.lit(" "), F.get(own, F.col("at") + n - 1))  # null behind the last word
        grams.append(F.struct(F.lit(n).alias("n"), F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int").alias("bucket")))
    every = places.select("doc_id", "th", "at", F.inline(F.array(*grams)))
    return every.filter(F.col("bucket").isNotNull() | (F.col("at").isNull() & (F.col("n") == 1)))


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all docs are in it; buckets without any are left out."""
    return features(docs, longest, buckets).filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def both_counts(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, s, t: how many features of docs and of the target are in each of the buckets."""
    spark = docs.sparkSession
    both = bucket_counts(docs, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    return both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))


def gains(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain; one row for each bucket. counts: see both_counts()."""
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return counts.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, th, n_words, n_features, weight for each row of docs. gain: see gains(), at most `buckets` rows."""
    found = features(docs, longest, buckets).join(F.broadcast(gain), "bucket", "left")
    # Equal rows of docs meet in one group, and each has one feature at place 0 (or the row without features).
    first = (F.coalesce("at", F.lit(0)) == 0) & (F.col("n") == 1)
    summed = found.groupBy("doc_id", "th").agg(
        F.sum(first.cast("long")).alias("copies"), F.sum((F.col("bucket").isNotNull() & (F.col("n") == 1)).cast("long")).alias("words"), F.count("bucket").alias("grams"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total")
    )
    each = lambda c: F.expr(f"{c} div copies")
    one = summed.select("doc_id", "th", "copies", each("words").alias("n_words"), each("grams").alias("n_features"), each("total").alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    return one.withColumn("weight", mean).withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select("doc_id", "th", "n_words", "n_features", "weight")


def noise(seed: int = SEED) -> Column:
    """Gumbel noise of doc_id in thousandths, floored."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank: 1, 2, 3, ... in that order, by a distributed sort and the partitions' offsets."""
    own = uuid.uuid4().hex  # apart from any column of rows
    taken, part, before = f"_m{own}", f"_p{own}", f"_b{own}"
    placed = Stored(rows.orderBy(*order).withColumn(taken, F.monotonically_increasing_id()), "sorted").df
    sizes = placed.groupBy(F.shiftright(taken, _PLACES).alias(part)).agg(F.count(F.lit(1)).alias("size"))
    # One row for each partition of the sort.
    offsets = sizes.select(part, (F.sum("size").over(Window.orderBy(part)) - F.col("size")).alias(before))
    found = placed.join(F.broadcast(offsets), F.shiftright(taken, _PLACES) == F.col(part))
    return found.withColumn("rank", F.col(before) + (F.col(taken) - F.shiftleft(part, _PLACES)) + 1).drop(taken, part, before)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs; rank is null if not drawn.

    Of the N rows with at least `least` words, the floor(percent * N / 100) with the highest scores are drawn.
    """
    rows = keyed(docs)
    counts = Stored(both_counts(rows, keyed(target.select(F.lit(0).alias("doc_id"), "text")), longest, buckets), "bucket-counts")
    scored = Stored(weights(rows, gains(counts.df, buckets), longest, buckets).withColumn("score", F.col("weight") + noise(seed)), "scores").df
    counts.drop()
    can = F.col("n_words") >= least
    placed = ranked(scored.filter(can), [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("th")])
    most = percent * scored.filter(can).count() // 100
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.filter(~can).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
