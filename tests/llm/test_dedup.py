"""SimHash, substring dedup and decontamination against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from stallmetrics.llm import decontaminate, similar_texts, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEY = "doc_id long, text string"


def brute_fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(pairs):
    """Smallest id of each component; pairs of (id, fingerprint)."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {(d, fp, least[find(i)]) for i, (d, fp) in enumerate(pairs)}


def _docs(n=120):
    rng = random.Random(5)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for i in range(n)]
    for i in range(n, n + 40):
        words = rows[i - n][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (903, "one two"), (3, rows[3][1]), (904, "long word " * 20_000)]


def test_simhash_equals_brute_force(spark):
    rows = _docs()
    found = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, KEY)).collect()}
    assert found == brute_components([(d, brute_fingerprint(t)) for d, t in rows])


@pytest.mark.parametrize("bucket", [32, 4096])
def test_links_of_full_buckets(spark, bucket):
    """Many fingerprints in one bucket of a half, to be divided again and again; nothing may be lost."""
    rng = np.random.default_rng(bucket)
    base = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    fps = {b ^ (sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(40)}
    fps |= {base[0] ^ (int(x) << 32) for x in rng.integers(0, 1 << 10, 80)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket)
    from stallmetrics.llm.components import components

    roots = {r.v: r.root for r in components(edges).collect()}
    name = {f: int(simhash.scatter(np.array([f], np.int64).view(np.uint64)).view(np.int64)[0]) for f in signed}
    groups = {f: roots.get(name[f], name[f]) for f in signed}
    want = {d: c for d, _, c in brute_components([(f, f % (1 << 64)) for f in signed])}
    as_sets = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert as_sets(groups) == as_sets(want)


def test_one_of_each_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a b c d", "x", 1), (1, "a b c d", "y", 2), (1, "a b c d", "y", 2), (5, None, "z", 3), (None, None, "n", 4)], "doc_id long, text string, fp string, root int")
    kept = simhash.one_of_each(df).collect()
    assert sorted((r.doc_id, r.fp) for r in kept) == [(1, "y"), (5, "z")] and kept[0].asDict().keys() == {"doc_id", "text", "fp", "root"}


def brute_wide(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh3_128_intdigest(s.encode()) for s in shingles]
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_set(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_stay(rows, most=26, similarity=0.8):
    """Of each component of texts that are equal in fingerprint, or as similar and at `most` or fewer differing bits, the smallest id."""
    fps, sets = [brute_wide(t) for _, t in rows], [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if fps[i] == fps[j] or (fps[i] ^ fps[j]).bit_count() <= most and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def _near_copies(n=40, seed=8):
    """Texts of 150 words, and copies of them with some words changed; each with the similarity of its five-word shingles."""
    rng = random.Random(seed)
    rows, pairs = [], []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows.append((10 * i, " ".join(words)))
        for c in (1, 2, 3):
            other = list(words)
            for p in rng.sample(range(150), c):
                other[p] = f"x{rng.randrange(10**6)}"
            a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words, other))
            rows.append((10 * i + c, " ".join(other)))
            pairs.append((10 * i + c, len(a & b) / len(a | b)))
    return rows, pairs


@pytest.mark.parametrize("bucket", [4, 100_000])
def test_similar_texts_equal_brute_force(spark, bucket):
    rows, pairs = _near_copies()
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, "one TWO"), (0, rows[0][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fa string, key int")
    found = similar_texts.one_of_each(df, bucket=bucket).collect()
    stay = {r.doc_id for r in found}
    assert len(found) == len(stay)
    assert stay == brute_stay(rows) and {9000, 9002} <= stay and not {9001, 9003} & stay
    near = [d for d, s in pairs if s >= 0.87]
    assert near and sum(d not in stay for d in near) >= 0.9 * len(near)
    assert similar_texts.one_of_each(df.filter("false")).count() == 0


def test_recall_of_similar_texts_at_the_limit(spark):
    """Of pairs with a similarity from 0.80 to 0.82 at least 95 in 100 are found, and none below 0.8 is taken for a copy."""
    rng, rows, near, far = random.Random(5), [], [], []
    for i in range(300):
        words = [f"w{rng.randrange(9000)}" for _ in range(400)]
        other, run = list(words), (36 if i % 3 else 60)
        at = rng.randrange(5, 390 - run)
        other[at : at + run] = [f"x{rng.randrange(10**6)}" for _ in range(run)]
        a, b = brute_set(" ".join(words)), brute_set(" ".join(other))
        alike = len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        assert 0.80 <= alike < 0.82 or alike < 0.75
        (near if alike >= 0.8 else far).append(2 * i + 1)
    stay = {r.doc_id for r in similar_texts.one_of_each(spark.createDataFrame(rows, KEY)).collect()}
    assert len(near) == 200 and sum(d not in stay for d in near) >= 0.95 * len(near)
    assert len(far) == 100 and set(far) <= stay and {2 * i for i in range(300)} <= stay


@pytest.mark.parametrize("scanned", [2, 64])
def test_no_link_is_lost_without_fingerprints(spark, monkeypatch, scanned):
    """Fingerprints that find nothing leave all links to the exact step, in small groups of a shingle and in large ones."""
    rng, rows = random.Random(7), []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 4, 5, 6, 30, 120]))] + "a line that stands at the end of all".split() * (i % 2)
        for _ in range(rng.choice([1, 2, 4])):
            other = list(words)
            for _ in range(rng.randrange(4)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(other[rng.randrange(2) :])))
    monkeypatch.setattr(similar_texts, "links", lambda distinct, most, bucket: distinct.selectExpr("0L AS a", "0L AS b"))
    monkeypatch.setattr(similar_texts, "SCANNED", scanned)
    rng.shuffle(rows)
    stay = {r.doc_id for r in similar_texts.one_of_each(spark.createDataFrame(rows, KEY), exact=True).collect()}
    assert stay == brute_stay(rows, most=128) and len(stay) < len(rows) - 10


def test_links_beyond_the_radius_are_found(spark):
    rows = _near_copies()[0]
    stay = {r.doc_id for r in similar_texts.one_of_each(spark.createDataFrame(rows, KEY), exact=True).collect()}
    assert stay == brute_stay(rows, most=128) != brute_stay(rows)


def test_often_found_shingles_make_no_candidates():
    """A shingle that all texts have is in no prefix of long ones if it stands last; a large group pairs only what may be alike."""
    n = 300
    columns = [np.zeros(n, np.int64), np.arange(n), np.r_[0, np.zeros(n - 2, np.int64), 1], np.sort(np.r_[np.full(n - 1, 100), 124]).astype(np.int32), np.zeros(n, np.int32)]
    found = [(int(x), int(y)) for a, b in similar_texts._met(0.8, *columns) for x, y in zip(a, b, strict=True)]
    assert sorted(found) == [(n - 1, y) for y in range(n - 1)]


def _passages(texts, seed=21):
    """Texts of 60 words that share a passage of 44 (each two far from 0.8), and a pair that is alike."""
    rng, passage = random.Random(seed), [f"p{i}" for i in range(44)]
    rows = [(i, " ".join([f"u{rng.randrange(10**9)}" for _ in range(8)] + passage + [f"u{rng.randrange(10**9)}" for _ in range(8)])) for i in range(texts)]
    return [*rows, (texts, rows[0][1] + " end")]


def test_texts_that_share_a_passage_make_no_candidates(spark):
    """The number of pairs to be read doesn't grow with the square of the texts that have a passage in common."""
    texts = spark.createDataFrame([(v, t) for v, t in _passages(400)], "v long, text string")
    roots = spark.createDataFrame([], "v long, root long")
    left = similar_texts.open_texts(texts, roots)
    assert {0, 400} <= {r.v for r in left.df.collect()}
    assert [tuple(r) for r in similar_texts.missed(left.df, roots).df.collect()] == [(0, 400)]
    assert [tuple(r) for r in similar_texts.missed(texts, roots, probe=True).df.collect()] == [(0, 400)]


def test_texts_alike_in_many_pairs_are_probed_by_few(spark):
    """Of 120 texts that are all alike a probe gives at most one pair for each first shingle; a group of texts is not read pair by pair."""
    rng, words = random.Random(22), [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:-1] + [f"x{rng.randrange(10**9)}"])) for i in range(120)]
    texts, roots = spark.createDataFrame(rows, "v long, text string"), spark.createDataFrame([], "v long, root long")
    few, every = (similar_texts.missed(texts, roots, probe=probe).df.count() for probe in (True, False))
    assert 119 <= few < 1_000 and every == 120 * 119 // 2
    met = spark.createDataFrame([(a, b, 1 + (b == 0)) for a in range(120) for b in range(a)], "a long, b long, n long")
    found = {tuple(r) for r in similar_texts.nearest(met).collect()}
    assert {(0, a) for a in range(1, 120)} <= found and len(found) <= 120 * similar_texts.NEAREST


def test_marks_are_a_lower_bound(spark):
    """No pair that is alike is lost by its marks."""
    rows = _near_copies(20)[0]
    texts, roots = spark.createDataFrame(rows, "v long, text string"), spark.createDataFrame([], "v long, root long")
    sets = {v: brute_set(t) for v, t in rows}
    alike = {(min(a, b), max(a, b)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.8 * len(x | y)}
    many = {tuple(r) for r in similar_texts.missed(texts, roots).df.collect()}
    assert alike and alike <= many


def test_copies_that_are_only_alike_to_their_original(spark):
    """Each copy shares 0.82 to 0.9 with the original, and less than 0.8 with most other copies: its link to the original has to be found."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(9000)}" for _ in range(400)]
    rows, n = [(0, " ".join(words))], 200
    for i in range(1, n + 1):
        other, run = list(words), rng.randrange(16, 34)
        at = rng.randrange(5, 390 - run)
        other[at : at + run] = [f"x{rng.randrange(10**6)}" for _ in range(run)]
        rows.append((i, " ".join(other)))
    sets = [brute_set(t) for _, t in rows]
    assert all(0.8 <= len(sets[0] & s) / len(sets[0] | s) < 0.91 for s in sets[1:])
    fps = np.array([[int.from_bytes(x.to_bytes(16, "big")[a : a + 8], "little") for a in (0, 8)] for x in (brute_wide(t) for _, t in rows)], np.uint64)
    order = rng.sample(range(n + 1), n + 1)
    edges = [(order[x], order[y]) for x, y in similar_texts._forest(fps[order], 26)]
    good = {x for e in edges for x in e if len(sets[e[0]] & sets[e[1]]) >= 0.8 * len(sets[e[0]] | sets[e[1]])}
    assert len(good) >= 0.95 * n
    stay = [r.doc_id for r in similar_texts.one_of_each(spark.createDataFrame(rows, KEY)).collect()]
    assert 0 in stay and len(stay) <= 1 + 0.05 * n


def brute_removal(rows, window):
    docs = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, docs, strict=True):
        gone = {p for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [21, 25, 35])
def test_substring_dedup_equals_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[f"p{i}x{j}" for j in range(rng.randint(20, 60))] for i in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(10**9)}" for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(100, None), (101, ""), (102, "same " * 200), (103, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (104, "ä " * 30 + "b " * 40)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, KEY), window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str) == brute_removal(rows, window)


def test_without_repeats_leaves_clean_texts(spark):
    long = " ".join(f"q{i}" for i in range(50))
    df = spark.createDataFrame([(1, f"head {long}\n\ntail", "a", 9), (2, f"{long}", "b", 9), (3, "  clean\n text ", "c", 9), (4, None, "d", None)], "doc_id long, text string, th string, n_chars long")
    found = {r.doc_id: r for r in substring_dedup.without_repeats(df).collect()}
    assert (found[1].text.split(), found[2].text, found[3].text, found[4].text) == (["head", "tail"], "", "  clean\n text ", None)
    assert found[1].th == "a" and found[2].n_chars == 0


def test_repetitive_words_are_no_repeats(spark):
    """Different words that a polynomial hash takes for the same."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    rows = [(i, " ".join([f"w{j}" for j in range(34)] + [w])) for i, w in enumerate((a, b))]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, KEY)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str) == brute_removal(rows, 35) and not any(r.n_removed for r in found)


def test_decontamination_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, "t", "i"), (2, "x y z", 2, "t", "i"), (2, "x y z", 2, "t", "i"), (None, None, 3, "t", "i")], "doc_id long, text string, _i int, _t string, item string")
    kept = decontaminate.without_contaminated(docs, spark.createDataFrame([("q", "a b")], "item_id string, text string"))
    assert kept.columns == docs.columns and sorted(r["_i"] for r in kept.collect()) == [2, 2, 3]
    assert decontaminate.without_contaminated(docs.filter("false"), spark.createDataFrame([("q", "a b")], "item_id string, text string")).count() == 0


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, window):
    words = lambda t: TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if (found := wins.get(tuple(w[i : i + k]))):
                    hit |= set(range(i, i + k))
                    ids |= found
        out.append((d, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    terms = ["the", "of", "a"] * 4 + [f"t{i}" for i in range(40)] + ["Ümlaut", "ABC", "x1y"]
    items = [(f"b{i}", ", ".join(rng.choices(terms, k=rng.randint(0, 25)))) for i in range(25)] + [("null", "the"), ("dup", "a b"), ("dup", "c d e"), ("none", None)]
    docs = []
    for i in range(80):
        text = " ".join(rng.choices(terms, k=rng.randint(0, 60)))
        if i % 3 == 0:
            words = items[i % 25][1].split(", ")
            text += f" {' '.join(words[rng.randint(0, 8) :]).upper()} {rng.choice(terms)}"
        docs.append((i, text))
    docs += [(500, None), (501, "!!!"), (0, docs[0][1]), (None, docs[3][1]), (502, "a-b. C d E")]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, KEY), spark.createDataFrame(items, "item_id string, text string"), 6).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found), key=str) == brute_hits(docs, items, 6)


def test_proximity(spark):
    terms = decontaminate.Stored(decontaminate.item_terms(spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")), "t").df
    docs = spark.createDataFrame([(1, "gamma x beta y alpha"), (2, "alpha " + "x " * 50 + "beta gamma")], KEY)
    index = decontaminate.postings(decontaminate.keyed(docs), terms)
    assert [(r.doc_id, r.item, r.near) for r in decontaminate.proximity_matches(index, terms).collect()] == [(1, "i", 3)]
