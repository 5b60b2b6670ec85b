"""Hierarchical language identification: the family first, then the language within it.

Features are hashed counts of the byte n-grams (1 to 3) of the whole text, A-Z lower-cased and other ASCII
than letters read as a blank. Families are told apart by a multinomial naive Bayes model, the languages
of one family by linear support vector machines, one against one; votes decide, then margins.

Models are fitted in the driver on a sample of labelled rows: at most `per_lang` rows of a language and
`rows` in all (documented bounds; their features are what is collected). The sample is drawn from the
distinct texts of a language by their hash, so it is the same each time and copies count once. Every row is then predicted, from its text alone.

Cases: null text, and text without a letter, is `und` with score 0, as is every text if nothing could be
learned; a null lang isn't learned from; languages with no family in FAMILIES are families of their own;
repeated rows get equal results; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, in_arrow
from .words import strings

DIM_BITS = 12
DIM = 1 << DIM_BITS
PER_LANG, ROWS = 600, 6000
UNKNOWN = "und"

# Languages of a family by their codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indo-aryan": "hi ur bn pa mr gu ne",
    "iranian": "fa ku ps",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_FOLD = np.full(256, 32, np.uint32)
for _c in range(26):
    _FOLD[[65 + _c, 97 + _c]] = 97 + _c
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    code = re.split("[-_]", lang.lower())[0]
    return _FAMILY.get(code, code)


def _counts(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Rows by DIM: hashed n-gram counts of data[marks[i]:marks[i + 1]]."""
    rows = len(marks) - 1
    row = np.repeat(np.arange(rows), np.diff(marks))
    out = np.zeros(rows * DIM, np.int64)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, 4):
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] * np.uint32(256) + _FOLD[data[n - 1 :]].astype(np.uint32)
        whole = row[n - 1 :] == row[: len(code)]
        hashed = ((code + np.uint32(n)) * np.uint32(2_654_435_761)) >> np.uint32(32 - DIM_BITS)
        out += np.bincount((row[: len(code)] * DIM + hashed)[whole], minlength=rows * DIM)
    return out.reshape(rows, DIM)


def _groups(text: pa.Array, rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """lo, hi, bytes and marks of groups of rows; long texts in small groups."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 2_000_000, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _unit(counts: np.ndarray) -> np.ndarray:
    """Root shares: rows of length 1."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


@dataclass
class Model:
    families: list[str]
    log_shares: np.ndarray  # families by DIM
    langs: dict[str, list[str]]  # of each family
    svms: dict[tuple[str, str], tuple[np.ndarray, float]]  # positive for the first

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        fit = counts @ self.log_shares.T / total
        which = fit.argmax(axis=1)
        # A text's n-grams depend on each other: at most 60 of them count as evidence.
        odds = np.exp(np.minimum(total, 60) * (fit - fit.max(axis=1, keepdims=True)))
        score = odds.max(axis=1) / odds.sum(axis=1)
        unit, out = _unit(counts), np.empty(len(counts), object)
        for f, name in enumerate(self.families):
            at, langs = np.flatnonzero(which == f), self.langs[name]
            if not len(at):
                continue
            votes, margins = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs)))
            least = np.full((len(at), len(langs)), np.inf)
            for (a, b), (w, c) in self.svms.items():
                if a in langs:
                    i, j, m = langs.index(a), langs.index(b), unit[at] @ w + c
                    for k, sign in ((i, 1), (j, -1)):
                        votes[:, k] += sign * m > 0
                        margins[:, k] += sign * m
                        least[:, k] = np.minimum(least[:, k], sign * m)
            best = (votes + 1e-3 * np.tanh(margins)).argmax(axis=1)
            out[at] = np.array(langs, object)[best]
            if len(langs) > 1:
                score[at] *= 1 / (1 + np.exp(-3 * least[np.arange(len(at)), best]))
        return out.tolist(), score


def _svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (hinge loss) by averaged stochastic subgradient steps."""
    rng, n = np.random.default_rng(7), len(x)
    x1 = np.hstack([x, np.ones((n, 1), np.float32)])
    w, mean, step = np.zeros(x1.shape[1]), np.zeros(x1.shape[1]), 0
    for epoch in range(epochs):
        for i in rng.permutation(n):
            step += 1
            rate = 1 / (penalty * (step + 1 / penalty))
            inside = y[i] * (x1[i] @ w) < 1
            w *= 1 - rate * penalty
            if inside:
                w += rate * y[i] * x1[i]
        if epoch >= epochs // 2:
            mean += w
    mean /= epochs - epochs // 2
    return mean[:-1].astype(np.float32), float(mean[-1])


def fit(counts: np.ndarray, langs: list[str]) -> Model | None:
    """From sampled rows; None if there are none."""
    if not langs:
        return None
    known = sorted(set(langs))
    families = sorted({family(x) for x in known})
    of = {f: [x for x in known if family(x) == f] for f in families}
    names = np.array(langs, object)
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    # Each language weighs the same in its family.
    by_family = np.stack([np.mean([shares[names == x].mean(axis=0) for x in of[f]], axis=0) for f in families])
    svms = {}
    unit = _unit(counts)
    for group in of.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                at = (names == a) | (names == b)
                svms[a, b] = _svm(unit[at], np.where(names[at] == a, 1, -1))
    return Model(families, np.log(by_family + 1e-6), of, svms)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, marks in _groups(strings(batch.column("text"))):
            counts = np.minimum(_counts(data, marks), np.iinfo(np.int32).max).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), pa.array([x.tobytes() for x in counts], pa.binary())], names=["lang", "counts"])


def train(labelled: DataFrame, per_lang: int = PER_LANG, rows: int = ROWS) -> Model | None:
    """A model of labelled (text, lang), fitted on the documented sample of it."""
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    hashed = labelled.withColumn("h", F.xxhash64("text", F.lit(1)))
    distinct = Stored(hashed.select("lang", "h").distinct(), "texts")
    sizes = distinct.df.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows // 2)
    langs = sizes.count()
    if not langs:
        return None
    each = min(per_lang, rows // langs)
    # Twice the texts that are needed, by hash, so that few are sorted; a language of few texts gives them all.
    likely = distinct.df.join(F.broadcast(sizes), "lang").filter(F.col("n") * (F.pmod(F.col("h"), F.lit(1 << 20)) / float(1 << 20)) < 2 * each + 20)
    first = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 20)), "h")
    chosen = likely.withColumn("row", F.row_number().over(first)).filter(F.col("row") <= each).select("lang", "h")
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("text", "lang")
    found = sample.mapInArrow(_count_rows, "lang string, counts binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    counts = np.array([np.frombuffer(r["counts"], "<i4") for r in found], np.int64).reshape(-1, DIM)
    return fit(counts, [r["lang"] for r in found])


def _predict(model: Model | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = strings(batch.column("text"))
        for lo, hi, data, marks in _groups(text):
            n = hi - lo
            letter = np.zeros(len(data) + 1, np.int64)
            np.cumsum((_FOLD[data] >= 97) & (data < 128), out=letter[1:])
            has = (letter[marks[1:]] - letter[marks[:-1]]) > 0
            for i in np.flatnonzero(~has & (np.diff(marks) > 0)):
                has[i] = any(map(str.isalpha, text[lo + int(i)].as_py()))
            langs, score = [UNKNOWN] * n, np.zeros(n)
            if model:
                langs, score = model.predict(_counts(data, marks))
            langs = [x if ok else UNKNOWN for x, ok in zip(langs, has, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(langs, pa.string()), pa.array(np.where(has, np.clip(score, 0, 1), 0.0))], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, from its text alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return in_arrow(rows, lambda b: _predict(model, b), "doc_id long, lang_pred string, score double")
