"""BPE against tiktoken, shards against the tokenizers library, wavelet matrices against numpy, token counts."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stallmetrics.llm import bpe, token_counts, token_shards
from stallmetrics.llm.units import Units
from stallmetrics.llm.wavelet import WaveletMatrix
from stallmetrics.llm.words import split_words

PATH, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
KEY = "doc_id long, text string"
TEXTS = [
    None, "", " ", "\n\n \t x", "Hello  world's  42nd <|endoftext|>", "naïve café — Grüße", "日本語 テキスト", "🙂🙂🙂 a b c", "aaaa" * 500, "x" * 70_000, "word " * 30_000, "\r\n\r\n", "a\x00b", "don't   stop\n\n\n now ", "  lead",
]


def _df(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), KEY)


def test_encoding_equals_tiktoken(spark):
    found = bpe.decode(bpe.encode(_df(spark), PATH, PATTERN), PATH).collect()
    for r in found:
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)
        assert bytes(r.decoded).decode() == text and r.n_tokens == len(r.ids) // 4
    assert bpe.encode(_df(spark).filter("false"), PATH, PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=20), st.integers(0, 60), st.integers(0, 60))
def test_prefix_table_appends_and_edits(data, more, a, b):
    v = bpe.vocabulary(PATH)
    table = bpe.PrefixTable(v, data)
    table.append(more)
    whole = data + more
    assert table.ids() == bpe.PrefixTable(v, whole).ids() and b"".join(v.tokens[i] for i in table.ids()) == whole
    lo, hi = sorted((min(a, len(whole)), min(b, len(whole))))
    table.edit(lo, hi, b"edit")
    assert table.ids() == bpe.PrefixTable(v, whole[:lo] + b"edit" + whole[hi:]).ids()


def test_letters_are_those_of_tiktoken():
    """Every assigned or new character behind a letter, a number and a mark; the planes without any are left out."""
    of = bpe._units(PATH, PATTERN)
    for base in [*range(0x80, 0x40000, 997), *range(0xE0000, 0xE0200, 16)]:
        text = "".join(f"a{c}1{c}!{c} " for c in map(chr, range(base, base + 997, 7)) if not 0xD800 <= ord(c) < 0xE000)
        assert np.frombuffer(of.encode([text])[0], "<u4").tolist() == REFERENCE.encode_ordinary(text)
    new = "a\U00016ea0b \u0558\U00011de0 1\U00011de0"
    assert np.frombuffer(of.encode([new])[0], "<u4").tolist() == REFERENCE.encode_ordinary(new)
    assert bpe.append(of.encode([new])[0], new, new, PATH, PATTERN) == of.encode([new + new])[0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40), st.text(max_size=20))
def test_units_and_append(text, more):
    encode = lambda t: np.array(REFERENCE.encode_ordinary(t), "<u4").tobytes()
    assert Units(lambda us: [encode(u) for u in us], 3).encode([text, more]) == [encode(text), encode(more)]
    assert bpe.append(encode(text), text, more, PATH, PATTERN) == encode(text + more)


def test_shards_equal_the_library(spark, tmp_path):
    t = Tokenizer.from_file(JSON)
    df = _df(spark)
    shards = token_shards.write_shards(df, JSON, str(tmp_path / "s"), shard_tokens=1000)
    found = {r.doc_id: r for r in token_shards.read_documents(shards).collect()}
    start, every = 0, []
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (found[i].start, found[i].n_tokens, np.frombuffer(found[i].ids, "<u4").tolist()) == (start, len(ids), ids)
        start, every = start + len(ids), every + ids
    token = every[5]
    assert token_shards.count_token(shards, token).agg(F.sum("n")).first()[0] == every.count(token)
    assert sorted(r["at"] for r in token_shards.find_token(shards, 2).collect()) == [i for i, x in enumerate(every) if x == 2]
    none = token_shards.write_shards(df.filter("false"), JSON, str(tmp_path / "none"))
    assert token_shards.read_documents(none).count() == 0


_SHARD_PIECES = st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "\t", "\u00a0", "word", " it's", "é", "日本", "123", "...", "\x85", "\u2028"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), _SHARD_PIECES), max_size=6))
def test_shard_encoder_equals_the_library(texts):
    t = Tokenizer.from_file(JSON)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in token_shards._encoder(JSON).encode(texts)] == want


def test_hashes_of_repetitive_words():
    """Words that a polynomial hash of any base takes for the same: a Thue-Morse sequence and its complement."""
    bits = np.array([bin(i).count("1") & 1 for i in range(4096)])
    a, b = ("".join("ab"[x] for x in row) for row in (bits, 1 - bits))
    words = next(split_words(pa.array([f"{a} {b} {a} x"])))
    h, g = words.hashes(0), words.hashes(1)
    assert h[0] == h[2] and g[0] == g[2] and h[0] != h[1] and g[0] != g[1]
    pair = next(split_words(pa.array([" ".join("ab"[x] for x in bits) + " " + " ".join("ab"[x] for x in 1 - bits)])))
    at = np.array([0, 4096, 1])
    for k in (1, 3, 15, 35, 1024, 4000):
        found = pair.windows(pair.hashes(), at, k)
        assert len(set(found.tolist())) == len({tuple(np.r_[bits, 1 - bits][i : i + k].tolist()) for i in at.tolist()})


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 50, n).astype(np.uint32)
    m = WaveletMatrix.build(values, 6)
    assert m.all().tolist() == values.tolist()
    for i in rng.integers(0, n, 20) if n else ():
        assert m.access(int(i)) == values[i] and m.rank(7, int(i)) == int((values[:i] == 7).sum())
    assert m.places(7) == np.flatnonzero(values == 7).tolist() and m.rank(99, n) == 0
    with pytest.raises(IndexError):
        m.select(7, n + 1)


def _brute_counts(text, spans, rule):
    counts, outside, at = [0.0] * len(spans), 0, 0
    data, ids = text.encode(), REFERENCE.encode_ordinary(text)
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    for i in ids:
        n = len(REFERENCE.decode_single_token_bytes(i))
        lo, hi = of_byte[at], of_byte[at + n - 1] + 1
        at += n
        over = [max(0, min(hi, b) - max(lo, a)) for a, b in spans]
        which = [k for k, x in enumerate(over) if x]
        if not which:
            outside += 1
        elif rule == "split":
            for k in which:
                counts[k] += over[k] / sum(over)
        else:
            counts[{"first": which[0], "last": which[-1], "most": max(which, key=lambda k: (over[k], -k))}[rule]] += 1
    assert at == len(data)
    return counts, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_equal_brute_force(spark, rule):
    rng, rows = random.Random(4), []
    for i, text in enumerate(["hello wonderful world of tokens", "naïve 🙂🙂 café\nGrüße an alle", "日本語", "", "internationalization " * 20]):
        cuts = sorted(rng.sample(range(len(text) + 1), min(6, len(text) + 1)))
        rows.append((i, text, [(a, b) for a, b in zip(cuts[::1], cuts[1:], strict=False)][:: rng.choice([1, 2])]))
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start: long, end: long>>")
    found = token_counts.attribute(df, PATH, PATTERN, rule, F.col("spans")).collect()
    for i, text, spans in rows:
        counts, outside = _brute_counts(text, spans, rule)
        mine = sorted((r for r in found if r.doc_id == i), key=lambda r: r.section)
        assert [r.n_tokens for r in mine] == pytest.approx(counts) and all(r.outside == outside for r in mine)


def test_lines_add_up(spark):
    found = token_counts.attribute(_df(spark), PATH, PATTERN)
    sums = {r.doc_id: (r.s, r.t) for r in found.groupBy("doc_id").agg(F.sum("n_tokens").alias("s"), F.max("doc_tokens").alias("t")).collect()}
    assert sums == {i: (len(REFERENCE.encode_ordinary(t or "")),) * 2 for i, t in enumerate(TEXTS)}
    fields = token_counts.with_fields(spark.createDataFrame([(1, "a title", None, "body text")], "doc_id long, title string, lead string, body string"), ["title", "lead", "body"])
    assert [r.n_tokens for r in token_counts.attribute(fields, PATH, PATTERN, spans=F.col("spans")).orderBy("section").collect()][1] == 0
