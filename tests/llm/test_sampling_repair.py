"""Resampling, sentence pieces and conversation repair against brute force, SQL and the library."""

import hashlib
import itertools
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stallmetrics.llm import repair, resample, sentence_pieces
from stallmetrics.llm.q13 import damaged

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: With a table of at most three chunks a generation.
SMALL = sentence_pieces.Pieces(MODEL, 3)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
KEY = "doc_id long, text string"


# ---- sentence pieces -------------------------------------------------------------------------------------------------

_PIECES = st.lists(st.sampled_from([" ", "  ", "▁", "▁▁", "a", "the", "\n", "\t", "é", "日本", "🙂", "\x00", "　", "<s>", "</s>", "<0x41>", "ing", "...", "ﬁ", "\U00016ea0"]), max_size=14).map("".join)
_TEXT = st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(_TEXT, _PIECES), max_size=6))
def test_chunks_equal_the_library(texts):
    model = SMALL
    assert model.by_chunks
    for _ in range(2):  # from the table the second time
        assert [list(memoryview(x).cast("I")) for x in model.encode(texts)] == LIBRARY.encode(texts)


def test_pieces_of_documents(spark):
    texts = [None, "", " ", "a ", "▁", " lead  and trail ", "x" * 50_000, "word " * 20_000, "naïve\n\nГрюше 日本語 🙂", "copy", "copy"]
    df = spark.createDataFrame([(None if i == 4 else i, t, "ids", 3) for i, t in enumerate(texts)], f"{KEY}, ids string, n_tokens int")
    found = sentence_pieces.decode(sentence_pieces.encode(df, MODEL), MODEL).collect()
    assert [r.doc_id for r in found] == [None if i == 4 else i for i in range(len(texts))]
    for r, text in zip(found, texts, strict=True):
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        assert list(memoryview(bytes(r.ids)).cast("I")) == ids and r.n_tokens == len(ids) and r.decoded == LIBRARY.decode(ids)
    assert sentence_pieces.encode(df.filter("false"), MODEL).count() == 0
    assert bytes(sentence_pieces.encode(df.filter("doc_id = 1"), MODEL, ends=False).first().ids) == b""


# ---- resampling ------------------------------------------------------------------------------------------------------


def _features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _brute(docs, target, percent, longest, buckets, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in _features(text, longest)[1]:
                counts[bucket(f)] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, found = _features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return rows, [r[:4] for r in drawn]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_equals_brute_force(spark, longest):
    rng, words = random.Random(longest), ["alpha", "Beta", "gamma", "Élan", "naïve", "日本", "x1", "the", "42"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    docs = [*enumerate(texts), (60, None), (61, ""), (62, "...  !"), (63, "one"), (None, "alpha beta " * 12), (64, "the " * 9000), (5, texts[5]), (6, "another text of a known id " * 4)]
    target = ["alpha beta gamma", None, "Élan vital. alpha beta"]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], f"{KEY}, word string, n int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample.resample(df, goal, percent=30, longest=longest, buckets=50, least=5).collect()
    rows, drawn = _brute(docs, target, 30, longest, 50, 5)
    assert sorted(map(str, (tuple(r)[:4] for r in found))) == sorted(str(r[:4]) for r in rows)
    # Equal rows may change places among themselves.
    assert [tuple(r)[:4] for r in sorted((r for r in found if r.rank), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in found if r.rank) == list(range(1, len(drawn) + 1))
    assert resample.resample(df.filter("false"), goal).count() == 0
    assert {r.weight for r in resample.resample(df.filter("doc_id > 59"), goal.filter("false"), buckets=50).collect()} >= {0}


def test_resampling_needs_no_python(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit(1).alias("th"))
    assert not re.search(r"Python|Pandas|Arrow|RDD", resample.features(df)._jdf.queryExecution().toString())


def test_ranks_go_on_over_partitions(spark):
    rows = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("clash").alias("part"))
    found = resample.ranked(rows.repartition(16), [F.desc("v")])
    assert found.filter(F.col("rank") != 5000 - F.col("v")).count() == 0 and found.columns == ["v", "part", "rank"]


# ---- conversation repair ---------------------------------------------------------------------------------------------


def _all_edits(rows):
    """Cost and audit of every way to edit up to two inserts between rows."""
    grammar = re.compile(r"(s?(ua)+)?\Z")
    seen, kinds = set(), []
    for role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        gone = not marks or (role, text) in seen
        seen.add((role, text))
        kinds.append((role[:1], gone, bool(marks) and not gone and marks[-1] not in ".!?"))
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("KuaD", repeat=len(rows)):
            cost, audit, roles = 2 * sum(map(len, inserts)), "I" * len(inserts[0]), inserts[0]
            for (initial, gone, cut), edit, added in zip(kinds, edits, inserts[1:], strict=True):
                if gone and edit != "D":
                    break
                cost += {"K": 0, "D": 3}.get(edit, 2) + (cut and edit != "D")
                audit += edit if edit in "KD" else "R"
                roles += {"K": initial or "?", "D": ""}.get(edit, edit) + added
                audit += "I" * len(added)
            else:
                if grammar.match(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_cheapest_edits_equal_all_edits(seed, spark):
    rng, convs = random.Random(seed), []
    for _ in range(2):
        convs.append([(rng.choice(["system", "user", "assistant", "assistant", "tool"]), rng.choice(["Hi.", "Yes!", "cut", " ", "what?"])) for _ in range(rng.randrange(1, 4))])
    for rows in convs:
        seen, letters = set(), ""
        for role, text in rows:
            mark = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 2 if not mark or (role, text) in seen else 1 if mark[-1] not in ".!?" else 0
            seen.add((role, text))
            letters += repair._LETTERS["sua".find(role[0]) % 4 * 3 + fault]
        assert repair.cheapest(repair.run(letters)) == _all_edits(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=repair._LETTERS, min_size=3, max_size=12), st.data())
def test_product_is_associative(letters, data):
    i = data.draw(st.integers(1, len(letters) - 2))
    j = data.draw(st.integers(i + 1, len(letters) - 1))
    a, b, c = (repair.run(x) for x in (letters[:i], letters[i:j], letters[j:]))
    assert repair.times(repair.times(a, b), c) == repair.times(a, repair.times(b, c)) == repair.run(letters)


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, at int")


def _assessed(spark, rows):
    placed = repair.placed(_turns(spark, rows)).df
    found = repair.assess(placed)
    return {r.conv_id: r for r in found.collect()}, repair.repaired(placed, found)


def test_a_hot_conversation_over_many_runs(spark, monkeypatch):
    """One conversation holds most rows; runs of four and groups of two must give what one scan gives."""
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Fine.", f"Turn {i}.", "cut off", ""])) for i in range(400)]
    rows += [(8, 0, "user", "Hello."), (8, 1, "assistant", "Hi."), (None, 5, "user", "alone?"), (9, None, None, None)]
    whole, _ = _assessed(spark, rows)
    monkeypatch.setattr(repair, "RUN", 2)
    monkeypatch.setattr(repair, "FAN", 1)
    parts, turns = _assessed(spark, rows)
    drop_at = lambda d: {k: {c: v for c, v in r.asDict().items() if c != "at"} for k, r in d.items()}
    assert drop_at(whole) == drop_at(parts)
    assert (whole[8].cost, whole[8].audit, whole[8].illegal) == (0, "KK", 0) and (whole[9].audit, whole[9].blank, whole[9].gaps) == ("D", 1, 0)
    assert (whole[None].cost, whole[None].audit) == (2, "KI")
    made = {}
    for r in turns.collect():
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    for k, found in made.items():
        assert re.fullmatch(r"(s?(ua)+)?", "".join(role[0] for role, _ in found)), k
    assert 9 not in made and made[8] == [("user", "Hello."), ("assistant", "Hi.")]
    assert sum(r.text == "" for r in turns.filter("conv_id = 7").collect()) == whole[7].audit.count("I")


def test_repair_cases(spark):
    assert _assessed(spark, [])[0] == {}
    same = [(1, 1, "user", "Twice."), (1, 1, "user", "Twice."), (1, 4, "assistant", "long " * 50_000)]
    found, turns = _assessed(spark, same)
    assert (found[1].gaps, found[1].duplicate, found[1].truncated, found[1].audit, found[1].cost) == (2, 1, 1, "KDK", 4)
    assert [(r.edit, r.role, len(r.text)) for r in turns.collect()] == [("K", "user", 6), ("K", "assistant", 250_000)]
    assert [r.n_turns for r in repair.digests(turns).collect()] == [2]
    assert damaged(_turns(spark, [(None, None, None, None)])).columns == ["conv_id", "turn", "role", "text"]
