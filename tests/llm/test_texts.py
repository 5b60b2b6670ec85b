"""Chat, quality, language and HTML; queries against SQL; the pipeline against brute force."""

import itertools
import re
import time
from html.parser import HTMLParser

import duckdb
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from stallmetrics.llm import chat, html_text, language, quality, queries
from stallmetrics.llm.q10 import op10_html_text
from tests.conftest import SF
from tests.llm.test_dedup import brute_hits, brute_removal, brute_stay
from tests.llm.test_tokens import REFERENCE

KEY = "doc_id long, text string, lang string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


_PIECES = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|\\im_end|>", "<|\\\\im_start|>", "\\", "\n", "\\n", "<|", "|>", "assistant", "a", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(_PIECES, _PIECES), max_size=5))
def test_chat_round_trip(turns):
    assert chat.parse("".join(chat.render(r, t) for r, t in turns)) == turns


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>user\n<|im_start|>a<|im_end|>\n"])
def test_chat_rejects(bad):
    with pytest.raises(chat.Malformed):
        chat.parse(bad)


def test_chat_cases(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (2, 0, "assistant", "one"), (2, 1, "user", "q"), (2, 2, "assistant", "two")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    read = {r.conv_id: (r.turns, r.loss) for r in chat.parse_chats(chat.format_chats(df)).withColumn("loss", chat.loss_text()).collect()}
    assert [tuple(t) for t in read[1][0]] == [("user", ""), ("assistant", "b")] and read[2][1] == "onetwo" and read[None][1] == ""
    assert chat.format_chats(df.filter("false")).count() == 0


def test_quality_cases(spark):
    good = (
        "The man and a woman of the town went to that old house by the sea, but it is not there. They had roses in one garden, you know, and all were red when he saw them. "
        "If more can be said, then her brother has no reason for a lie, or so which of us may think. From this hill we are at home with his dogs as if on an island."
    )
    rows = [(1, None, "en"), (2, "", None), (3, "x " * 100, "en"), (4, good, "en"), (4, good, "en"), (5, good, None), (6, "#$% &&& ||| " * 40 + " ".join(f"<{i}>" for i in range(300)), "en"), *[(10 + i, f"{good} {'at' if i % 2 else 'by'} {i}", "en") for i in range(20)]]
    df = spark.createDataFrame(rows, KEY).withColumn("n_words", F.lit("clash"))
    found = {r.doc_id: r for r in quality.judge(df).collect()}
    assert [found[i].base_failed for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert found[4].kept and found[5].kept and not found[6].kept and found[3].n_repeat_words == 100
    kept = quality.good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {4, 5, *range(10, 30)}
    assert quality.judge(df.filter("false")).count() == 0


def test_quality_copies_are_no_reference(spark):
    """One text of quality 0, copied until it is a third of its language's rows, changes no verdict on the others."""
    path = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("lang = 'en'")
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality")
    plain = quality.judge(docs).filter("NOT base_failed").join(labels, "doc_id")
    junk = plain.filter("quality = 0").orderBy("doc_id").first()["doc_id"]
    n = docs.count() // 2
    copies = docs.filter(F.col("doc_id") == junk).withColumn("doc_id", F.explode(F.sequence(F.lit(10**6), F.lit(10**6 + n)))).select(docs.columns)
    after = quality.judge(docs.unionByName(copies)).filter("doc_id < 1000000").select("doc_id", F.col("kept").alias("after"))
    assert plain.join(after, "doc_id").filter("kept <> after").count() == 0


def test_quality_without_language(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").select("doc_id", "quality"), "doc_id")
    # Every other document loses its lang, or has one that no reference is learned of.
    some = docs.withColumn("known", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 4 == 1, None).when(F.col("doc_id") % 4 == 3, F.concat(F.lit("x-"), "doc_id")).otherwise(F.col("lang")))
    refs = quality.references(quality.features(docs))
    found = quality._judged(quality.features(some), refs).filter("NOT base_failed").join(some.select("doc_id", "known", "quality"), "doc_id").filter("doc_id % 2 = 1")
    shares = {(r.quality, r.known): r.share for r in found.groupBy("quality", "known").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert all(shares[1, lang] >= 0.95 for lang in ("en", "de", "fr", "es"))
    assert found.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] <= 0.1


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    out = language.held_out(F.col("doc_id"))
    found = language.predict(docs, language.train(docs.filter(~out))).join(docs.select("doc_id", "lang").filter(out & F.col("lang").isNotNull()), "doc_id").filter("lang_pred <> 'und'")
    right, n = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.95


def test_language_cases(spark):
    rows = [(1, "the cat sat on the mat and it was warm", "en"), (2, "der Hund lag auf dem Boden und schlief", "de"), (3, "le chat est sur la table et dort", "fr"), (4, None, "en"), (5, "123 !?", "en"), (6, "", None), (7, "日本", None), (8, "½ ² ① Ⅷ", "en")]
    df = spark.createDataFrame(rows, KEY)
    model = language.train(df)
    found = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert [found[i].lang_pred for i in range(1, 7)] == ["en", "de", "fr", "und", "und", "und"] and found[7].lang_pred != "und"
    assert (found[8].lang_pred, found[8].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language.train(df.filter("false")) is None
    assert {r.lang_pred for r in language.predict(df, None).collect()} == {"und"}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>The   head&nbsp;line</h1><p>First para with <b>bold</b>text &amp; more words to read here.</p><p>Second<br>line of a paragraph that goes on.</p>
<div class="ad-banner">Buy now</div></article></main><aside>Side</aside><section id="comments"><p>I think so too, says a reader of the page.</p></section><form><input>Send</form><script>var x = "<p>no</p>";</script><footer>(c) us</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "The head line\nFirst para with boldtext & more words to read here.\nSecond line of a paragraph that goes on."


LINES = ["The first paragraph of the story says what has happened, and where.", "Ulm", "A second paragraph goes on at some length about the people of the town.", "Read more there", "And a third one ends it."]
ARTICLE = "<h1>A title</h1>" + "".join(f"<p>{'<a href=/x>' * (i == 3)}{t}{'</a>' * (i == 3)}</p>" for i, t in enumerate(LINES))
MENU = "<div><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li>You are here</li><li><a href=/c>Contact us</a></li></ul></div>"


@pytest.mark.parametrize(
    "page",
    [
        "<form id=aspnetForm>{menu}<div>{article}</div></form>", "<div class='content with-sidebar'><article>{article}</article></div><div class=sidebar><p>{side}</p></div>",
        "<div class='no-sidebar'>{article}</div><footer><p>{side}</p></footer>", "<article class='post legal'>{article}</article>", "{menu}<div>{article}</div>",
        "<main>{article}</main><section id=comments><article class=comment><p>{side}</p></article></section>", "<div class=cookie-notice><p>{side}</p></div><div>{article}</div>",
        "<header><h2>Site</h2>{menu}</header><article><header>{article}</header></article>",
    ],
)
def test_html_wrappers(page):
    side = "I think that this is a long sentence which somebody wrote about something else. " * 3
    assert html_text.main_text(page.format(article=ARTICLE, menu=MENU, side=side)) == "\n".join(["A title", *LINES])


def test_the_cut_overrules_the_classifier():
    """Blocks whose own odds are wrong get the right label from their neighbours."""
    page = html_text.read(f"{MENU}<div>{ARTICLE}</div>")
    alone, cut = [html_text.log_odds(b) > 0 for b in page.blocks], html_text.content(page)
    want = [b.text in {"A title", *LINES} for b in page.blocks]
    assert cut == want and sum(a != w for a, w in zip(alone, want, strict=True)) >= 2


class _Oracle(HTMLParser):
    """The library's own reader, told which elements of the tables' pages hold the article and what in them is not of it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in html_text.BLOCK_TAGS:
            self.blocks.append("")
        if tag not in html_text.VOID_TAGS:
            self.open.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK_TAGS:
            self.blocks.append("")
        while any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        inside = [i for i, (t, _) in enumerate(self.open) if t == "article"]
        out = any(t in ("script", "style", "form", "aside", "nav", "footer") or c in ("ad", "comment", "comments", "cookie", "share") for t, c in self.open)
        if inside and not out:
            self.blocks[-1] += data


def test_html_query_equals_an_oracle_by_the_tables_markup(spark):
    sf = SF.replace("0.001", "0.01")
    want = {}
    for r in pq.read_table(f"{sf}/pages.parquet").to_pylist():
        reader = _Oracle()
        reader.feed(r["html"] or "")
        reader.close()
        want[r["page_id"]] = "\n".join(t for b in reader.blocks if (t := " ".join(b.split())))
    found = {r.page_id: r for r in op10_html_text(spark, sf).collect()}
    assert {k: r.text for k, r in found.items()} == want and all(r.n_chars == len(r.text) for r in found.values())


PARAGRAPHS = "".join(f"<p>Paragraph {i} of the story says at some length what has happened, and where.</p>" for i in range(6))
WRAPPERS = [
    "<div class='layout sidebar-right'>", "<div id='page-comments-on'>", "<div class='banner-layout'>", "<div class='post social-post'>", "<article class='entry share-enabled'>", "<article class='post comments-open'>", "<main class='related'>",
    "<div aria-hidden='true'>", "<div id=wrap class='sidebar-left'><div class='sidebar'><h3>Recent</h3><p>A teaser of another story is written here at length.</p></div><div class=col>",
]


@pytest.mark.parametrize("title", ["", "<h1>A title</h1>"])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_html_names_of_wrappers_and_articles(wrapper, title):
    page = f"<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>{wrapper}{title}{PARAGRAPHS}</div></article></main></div><footer><p>(c) us and others, all rights reserved.</p></footer>"
    found = html_text.main_text(page).split("\n")
    assert found == ["A title"] * bool(title) + [f"Paragraph {i} of the story says at some length what has happened, and where." for i in range(6)]


@pytest.mark.parametrize("marked", ["<div class=comments>{}</div>", "<section id=comment-list>{}</section>", "<div class='related-posts'>{}</div>", "<div class='left-sidebar'>{}</div>", "<div class='newsletter-signup'>{}</div>"])
def test_html_names_of_boilerplate(marked):
    said = "<article class=comment><p>I think so too, says somebody else, and goes on at length about it.</p></article>" * 20
    assert html_text.main_text(f"<main><h1>A title</h1>{PARAGRAPHS}</main>{marked.format(said)}").count("\n") == 6


@pytest.mark.parametrize("page", ["<p>a<![foo]>b</p>", "<p>ab <![ x", "<p>ab</p><a <a <a", "<p>ab<!-- <p>c", "<p>ab</p></a ", "<p>ab</p>&#" + "9" * 5000 + "<"])
def test_html_broken_markup(page):
    assert "ab" in "\n".join(b.text for b in html_text.read(page).blocks)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=5), st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<a ", "<!", "<![", "<!--", "-->", "<b>", "</b>", "<li>", "<td>", "<article>", "<h1>", "<script>", "</script>", "<head>", "<body>", "&amp", "<br/>", "words of a text. "])), max_size=30).map("".join))
def test_html_of_any_kind_is_read(page):
    text = html_text.main_text(page)
    assert all(b == " ".join(b.split()) and b for b in text.split("\n")) or text == ""


@pytest.mark.parametrize("piece", ["<a ", "</a ", "<!--", "<p>x", "<li>x y", "<i><div><b></i>", "<a href=x>y</a> ", "<div class=comment>a b c."])
def test_html_hostile_pages_take_seconds(piece):
    began = time.perf_counter()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    html_text.main_text("<b>" * 100_000 + "<p>x</p>" * 30_000 + "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000)
    assert time.perf_counter() - began < 25


def test_html_deep_nesting_is_linear():
    seconds = []
    for n in (5_000, 20_000):
        html = "<div>x <span>" * n + "</section></i>" * n
        began = time.perf_counter()
        assert html_text.main_text(html) is not None
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * seconds[0] + 1


@pytest.mark.parametrize("rest", ["<body><p>{}", "<p>{}", "<div><noscript>x</noscript><p>{}</div>", "{}", "<noscript><link></noscript><span>{}</span>", "<noscript><link><body><p>{}"])
def test_html_head_without_end(rest):
    text = "Words of a page whose head has no end tag."
    assert html_text.main_text("<html><head><meta charset=utf-8><title>T</title><style>p{}</style>" + rest.format(text)) == text


def test_html_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" + "open " * 50_000), (4, "u", "<<<>>"), (5, "u", PAGE), (5, "u", PAGE)]
    found = html_text.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == 6 and by[1].text == by[2].text == "" and by[3].n_chars == 50_000 * 5 - 1 and all(r.n_chars == len(r.text) for r in found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 9)), max_size=8))
def test_flow_is_the_minimum_cut(terminals, ties):
    n = len(terminals)
    flow = html_text.Flow(n + 2)
    ties = [(a % n, b % n, c) for a, b, c in ties if a % n != b % n]
    for i, (s, t) in enumerate(terminals):
        flow.add(n, i, s)
        flow.add(i, n + 1, t)
    for a, b, c in ties:
        flow.add(a, b, c, c)
    cost = lambda inside: sum(t if i else s for i, (s, t) in zip(inside, terminals, strict=True)) + sum(c for a, b, c in ties if inside[a] != inside[b])
    found = [x >= 0 for x in flow.run(n, n + 1)[:n]]
    assert cost(found) == min(map(cost, itertools.product((False, True), repeat=n)))


def test_pipeline_equals_brute_force(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    kept = {r.doc_id for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    docs = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in kept]
    first = brute_stay(docs)
    docs = [x for x in docs if x[0] in first]
    removed = {d: (n, k) for d, _, n, k in brute_removal(docs, 35)}
    words = {d: removed[d][1] if removed[d][0] else t for d, t in docs}
    clean = {d for d, _, _, _, bad in brute_hits(list(words.items()), items, 10) if not bad}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(found) == clean
    whole = [d for d in clean if not removed[d][0]]
    assert whole and all(found[d].n_tokens == len(REFERENCE.encode_ordinary(words[d] or "")) for d in whole)
    assert public_tokenizers.PATTERN and corpus_pipeline.ORACLE_SQL is None


def test_quality_equals_its_sql_without_a_language(spark):
    """Rows of no language, and of one that no good document has, are held against every language."""
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    for i, r in enumerate(rows):
        r["lang"] = None if i % 7 == 0 else "zz" if len((r["text"] or "").split()) < 50 else r["lang"]
    table = pa.Table.from_pylist(rows)
    found = quality.judge(spark.createDataFrame(table.to_pandas()[["doc_id", "text", "lang"]], KEY)).select("doc_id", "base_failed", "kept").collect()
    con = duckdb.connect()
    con.register("documents", table)
    want = con.execute(f"SELECT doc_id, base_failed, kept FROM ({queries.oracle_sql()['op4_quality']})").fetchall()
    assert sorted(tuple(r) for r in found) == sorted(want)
