r"""Benchmark decontamination over a distributed positional inverted index.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased. A window is `window`
consecutive words of an item; an item of fewer words, but not none, is one window.

Index. postings() lists (document, term, position) for the terms that a query asks for, and one
posting of a length term for each document, written once to the shared folder. A posting is a row:
no list of a frequent term is ever gathered.

Query. The index gives each term's number of postings. In each window the `rarest` terms are its
anchors. Each anchor posting is shifted by the anchor's offset in its item, which gives the place
where the item would begin; lists that agree on (document, item, begin) intersect there, by an
aggregate with map-side combining. What as many anchors share as a window has is a candidate. All
the item's terms are then looked up in the candidate's document, and runs of consecutive offsets
as long as a window are exact matches. phrase_matches() returns those runs; proximity_matches()
documents that have an item's rarest terms within some distance, in any order.

The vocabulary, the anchors and the candidates are broadcast only if they have few enough rows,
else joined by shuffle.

Cases: null or empty text has no words; a null doc_id is a key like another; rows that repeat a
doc_id are documents of their own if their texts differ, else each gets the same result; repeated
benchmark rows count once; a null item_id counts as the item named "null"; empty tables give zero
hits or no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Stored, keyed, small

WINDOW = 10
RAREST = 3
#: Bytes of terms or item names that may be broadcast, besides the number of rows.
BROADCAST_BYTES = 16 << 20

#: What stands between words; upper case is still there when texts are split.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands behind the last word, once for itself and once for each empty string that splitting leaves at an end.
_END = "\x01"


def _lower(word: Column) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def _split(text: Column) -> Column:
    """The words, an empty string before the first or behind the last if the text has other characters there, and the end mark."""
    words = F.split(text, _BETWEEN)
    blanks = F.when(text == "", 1).otherwise((F.element_at(words, 1) == "").cast("int") + (F.element_at(words, -1) == "").cast("int"))
    return F.concat(words, F.array(F.repeat(F.lit(_END), blanks + 1)))


def _small(df: DataFrame, *texts: str) -> DataFrame:
    """As small(), for rows with texts of any length."""
    most = BROADCAST_ROWS + 1
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0).cast("long"))
    found = df.limit(most).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] < most and found["bytes"] <= BROADCAST_BYTES else df


def item_terms(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (its id as text), ik (tells texts of one id apart), off, term, size (words of its windows)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    words = F.filter(F.split(_lower(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    return (
        items.select("item", F.xxhash64("text").alias("ik"), words.alias("words"))
        .select("item", "ik", F.least(F.size("words"), F.lit(window)).alias("size"), F.posexplode("words").alias("off", "term"))
    )


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, th, term, at: each place of one of the terms (column term), and of the end marks. docs: see keyed()."""
    ends = docs.sparkSession.range(1, 4).select(F.repeat(F.lit(_END), F.col("id").cast("int")).alias("term"))
    # Words are matched by their Unicode lower case, which is cheap; where that differs from the word itself, A-Z alone decide.
    asked = _small(terms.select("term").union(ends).distinct().withColumn("folded", F.lower("term")), "term")
    words = docs.select("doc_id", "th", F.posexplode(_split(F.col("text"))).alias("at", "word"))
    found = words.join(asked, F.lower("word") == F.col("folded")).filter((F.col("word") == F.col("term")) | (_lower(F.col("word")) == F.col("term")))
    return found.select("doc_id", "th", "term", "at")


def lengths(index: DataFrame) -> DataFrame:
    """doc_id, th, n_words; one row for each row of the documents."""
    return index.filter(F.col("term").startswith(_END)).select("doc_id", "th", (F.col("at") - F.length("term") + 1).cast("long").alias("n_words"))


def anchors(terms: DataFrame, index: DataFrame, rarest: int = RAREST) -> DataFrame:
    """item, ik, off, term, needed: for each window its rarest terms by postings. A term that is in no document makes its window impossible."""
    counts = index.filter(~F.col("term").startswith(_END)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = terms.join(_small(counts, "term"), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    spread = known.withColumn("start", F.explode(F.expr("sequence(greatest(off - size + 1, 0), off)")))
    by_window = Window.partitionBy("item", "ik", "start")
    ranked = spread.withColumn("words", F.count(F.lit(1)).over(by_window)).withColumn("least", F.min("n").over(by_window)).withColumn("rank", F.row_number().over(by_window.orderBy("n", "off")))
    whole = ranked.filter((F.col("words") == F.col("size")) & (F.col("least") > 0) & (F.col("rank") <= rarest))
    return whole.select("item", "ik", "off", "term", F.least(F.col("size"), F.lit(rarest)).alias("needed")).distinct()


def candidates(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, th, item, ik, begin: where enough anchors of an item agree on its begin."""
    shifted = index.join(_small(chosen, "term", "item"), "term").select("doc_id", "th", "item", "ik", (F.col("at") - F.col("off")).alias("begin"), "needed")
    met = shifted.groupBy("doc_id", "th", "item", "ik", "begin").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"))
    return met.filter(F.col("n") >= F.col("needed")).drop("n", "needed")


def phrase_matches(index: DataFrame, terms: DataFrame, rarest: int = RAREST) -> DataFrame:
    """doc_id, th, item, first, last: each longest run of a document's words that equals consecutive item words and holds a window."""
    found = Stored(candidates(index, anchors(terms, index, rarest)), "candidates").df
    met = _small(found.withColumnsRenamed({"doc_id": "c_doc_id", "th": "c_th"}), "item")
    on = (index["th"] == met["c_th"]) & index["doc_id"].eqNullSafe(met["c_doc_id"])
    looked_up = index.join(met, on).withColumn("off", F.col("at") - F.col("begin")).join(_small(terms, "term", "item"), ["item", "ik", "off", "term"]).select("doc_id", "th", "item", "ik", "begin", "off", "size").distinct()
    by_off = Window.partitionBy("doc_id", "th", "item", "ik", "begin").orderBy("off")
    runs = looked_up.withColumn("run", F.col("off") - F.row_number().over(by_off)).groupBy("doc_id", "th", "item", "ik", "begin", "run").agg(F.min("off").alias("lo"), F.max("off").alias("hi"), F.max("size").alias("size"))
    return runs.filter(F.col("hi") - F.col("lo") + 1 >= F.col("size")).select("doc_id", "th", "item", (F.col("begin") + F.col("lo")).alias("first"), (F.col("begin") + F.col("hi")).alias("last"))


def proximity_matches(index: DataFrame, terms: DataFrame, rarest: int = RAREST, within: int = 20) -> DataFrame:
    """doc_id, th, item, near: how many of an item's rarest terms stand within so many words of the rarest one, for documents that have them all there."""
    counts = index.filter(~F.col("term").startswith(_END)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    distinct = terms.select("item", "ik", "term").distinct().join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("item", "ik").orderBy("n", "term"))).filter(F.col("rank") <= rarest)
    needed = F.max("rank").over(Window.partitionBy("item", "ik"))
    chosen = _small(ranked.withColumn("needed", needed).select("item", "ik", "term", "rank", "needed"), "term", "item")
    places = index.join(chosen, "term")
    lead, rest = places.filter("rank = 1").withColumnRenamed("at", "lead"), places.select("doc_id", "th", "item", "ik", "rank", "at")
    # Ranges of width `within` make the distance an equality: a pair lies in the same range or in the next.
    cut = lambda at: F.floor(at / within)
    near = lead.select("doc_id", "th", "item", "ik", "lead", "needed", F.explode(F.array(*[cut(F.col("lead")) + d for d in (-1, 0, 1)])).alias("cut"))
    rest = rest.withColumn("cut", cut(F.col("at"))).withColumnRenamed("doc_id", "r_doc_id")
    pairs = near.join(rest, ["th", "item", "ik", "cut"]).filter(F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.abs(F.col("at") - F.col("lead")) <= within))
    met = pairs.groupBy("doc_id", "th", "item", "ik", "lead", "needed").agg(F.count_distinct("rank").alias("near")).filter(F.col("near") == F.col("needed"))
    return met.select("doc_id", "th", "item", "near").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """One row for each row of docs: doc_id, th (see keyed), n_words, n_hit, n_items, items (sorted list), contaminated."""
    terms = Stored(item_terms(benchmark, window), "items").df
    index = Stored(postings(keyed(docs), terms), "postings").df
    hits = Stored(phrase_matches(index, terms, rarest), "hits").df
    covered = hits.select("doc_id", "th", F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("doc_id", "th", "item").distinct().groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = covered.join(items, covered["th"].eqNullSafe(items["th"]) & covered["doc_id"].eqNullSafe(items["doc_id"])).select(covered["doc_id"].alias("h_doc_id"), covered["th"].alias("h_th"), "n_hit", "items")
    docs_ = lengths(index)
    found = docs_.join(both, (docs_["th"] == both["h_th"]) & docs_["doc_id"].eqNullSafe(both["h_doc_id"]), "left")
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return found.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_or_none).cast("long").alias("n_items"), items_or_none.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with all their columns, whatever their names; rows that repeat all stay or all go."""
    bad = Stored(decontaminate(docs, benchmark, window, rarest).filter("contaminated").select(F.col("doc_id").alias("_i"), F.col("th").alias("_t")).distinct(), "contaminated").df
    # Rows go as structs, so that no column of theirs can be taken for the key.
    whole = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"))
    return whole.join(small(bad), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left_anti").select("_doc.*")
