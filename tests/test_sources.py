"""Result pages and view counters against pinned cases."""

import pytest
from pyspark.sql import functions as F

from stallmetrics.sources import result_pages as rp
from stallmetrics.sources import view_counters as vc

HOST, BASE = "market.example", "https://www.market.example"
FEED = f"{BASE}/s-film-dvd/c79"


def card(n, title="Normal", date='<div class="aditem-main--top--right">Heute, 10:01</div>', price='<div class="aditem-main--middle--price-shipping--price">15 € VB</div>', wrapper="ad-listitem", more=""):
    return f'<li class="{wrapper}">{more}<a href="/s-anzeige/x/{n}-79-1"><h2>{title}</h2></a>{date}{price}</li>'


def ids(n, first=223456000):
    return [first + i for i in range(n)]


CASES = {
    # Name: html, requested page, final address.
    "dates": (card(123456789, "Film vom 10.08.2026", '<div class="aditem-main--top--right">Gestern, 14:30</div>') + card(123456790, "Ohne 11.08.2026", "", "<p>+ Versand ab 1,49 €</p><p>1.250 €</p>"), 1, FEED),
    "promoted": (card(1000001, wrapper="ad-listitem is-topad") + card(1000002, more='<span class="featurelabel-bumpup"><i></i></span>') + card(1000003, more='<i data-testid="feature-bumpup"></i>') + card(1000004, more="<span>Top-Anzeige</span>") + card(1000005, "Top Anzeige lesen, Push Up Board"), 1, FEED),
    "copies": (card(2000001) + card(2000001) + card(2000002, "") + f'<article><a href="https://elsewhere.example/s-anzeige/x/2000003-1-1"><h2>X</h2></a></article>', None, None),
    "second": ("<p>26 - 50 von 1.234</p>" + "".join(card(i) for i in ids(10)), 2, f"{BASE}/s-film-dvd/seite%3A2/c79"),
    "third": ("<p>55 - 81 von 1.234</p>" + card(3000001), 3, FEED),
    "beyond": ("<p>1 - 25 von 30</p>" + card(3000001), 4, FEED),
    "other": (card(3000001), 2, f"{BASE}/s-film-dvd/seite:5/c79"),
    "robots": (card(4000001, "Mähroboter robot") + f'<ul><li><a href="/s-film/ulm/c79l2">Ulm</a> (1.200)</li><li><a href="/s-film/bonn/c79l3">Bonn</a> (7)</li><li><a href="/s-film/hier/c79l9">Hier</a> (5)</li><li><a href="/s-x/c80l3">X</a></li></ul>', 1, f"{BASE}/s-film/c79l9"),
    "challenge": ("<h1>Bist du ein Roboter?</h1>", 1, FEED),
    "empty": (None, 1, FEED),
}


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(k, *v) for k, v in CASES.items()], "name string, html string, requested_page int, final_url string")
    found = rp.pages(df, BASE, HOST)
    assert found.columns == [*df.columns, "info"] and rp.pages(df.filter("false"), BASE, HOST).count() == 0
    assert rp.items(found, "name").filter("name = 'second'").count() == 10
    return {r["name"]: r["info"] for r in found.collect()}


def test_items(read):
    a, b = read["dates"]["items"]
    assert (a.external_id, a.title, a.posted_text, a.price_text, a.price_eur) == ("123456789", "Film vom 10.08.2026", "Gestern, 14:30", "15 € VB", 15)
    assert (b.posted_text, b.price_eur) == (None, 1250) and read["dates"]["missing_date_count"] == 1 and read["dates"]["date_coverage"] == 0.5
    assert [x.external_id for x in read["promoted"]["items"]] == ["1000005"]
    assert read["promoted"]["promoted_filtered"] == 4 and list(read["promoted"]["promoted_ids"]) == ["1000001", "1000002", "1000003", "1000004"]
    copies = read["copies"]
    assert [x.external_id for x in copies["items"]] == ["2000001"] and copies["duplicate_cards"] == 1 and copies["raw_candidates"] == 4


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_computed_once(spark):
    df = spark.createDataFrame([(1, "", 1, FEED)], "k int, html string, requested_page int, final_url string")
    plan = _plan(rp.items(rp.pages(df, BASE, HOST), "k"))
    assert "size(" not in plan and plan.count("ArrowEvalPython") == 1


def test_joined_is_urljoin():
    for href in ("/s-anzeige/x/1-79-1", "//a/b", "/a/../b", "?x=1", "/a?", "/a#", "x", "", "/", "/a b", "/a\n", "https://o.example/a", "/a//b"):
        assert rp._joined(BASE, href) == rp.urljoin(BASE, href) and rp._joined(f"{BASE}/", href) == rp.urljoin(f"{BASE}/", href)


def test_allowed_addresses_with_and_without_parsing(spark):
    urls = [f"{BASE}/a/1-2", "https://market.example", "https://market.example/a b", "https://market.example\n", "https://evilmarket.example/", "https://market.example.evil/x", "http://market.example/", "https://a@market.example/", "https://-a.market.example/", f"{BASE}/ä?x", None]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select(rp.X.allowed_url(F.col("u"), HOST)).collect()
    assert [r[0] for r in found] == [True, True, False, False, False, False, False, True, False, True, False]


def test_texts_are_computed_once_for_all_words(spark):
    df = spark.createDataFrame([("u", 200, "<p>x</p>")], "url string, status int, html string")
    plan = _plan(df.select(vc.available(F.col("url"), F.col("status"), F.col("html"), F.col("url")).alias("a"), vc.document_kind(F.col("html")).alias("d")))
    assert "lower(" in plan and "Contains(lower(" not in plan


def test_a_counter_is_computed_once(spark):
    df = spark.createDataFrame([("x",)], "html string")
    first = vc.first_counter(("html", vc.html_views(F.col("html"))), ("text", vc.extra_views(F.col("html"))))
    assert 0 < _plan(df.select(first.alias("f"))).count("viewad-cntr-num") <= 2


def test_page_identity(read):
    def of(n):
        i = read[n]
        return i["result_start"], i["total_results"], i["stride"], i["actual_page"], i["max_page"], i["request_matches_page"], i["page_verified"]

    assert of("second") == (26, 1234, 25, 2, 50, True, True)
    assert of("third") == (55, 1234, 27, 3, 46, True, True)
    assert of("beyond") == (1, 30, 25, 1, 2, False, False)
    assert of("other") == (None, None, 25, None, None, False, False)
    assert read["empty"]["page_verified"] and read["empty"]["fingerprint"] == "" and not read["empty"]["items"]
    assert read["second"]["fingerprint"] == "|".join(map(str, ids(10)[:6] + ids(10)[-3:]))


def test_challenge_and_feeds(read):
    assert read["challenge"]["suspicious"] and not read["robots"]["suspicious"]
    assert [(x["count"], x["url"]) for x in read["robots"]["location_shards"]] == [(7, f"{BASE}/s-film/bonn/c79l3"), (1200, f"{BASE}/s-film/ulm/c79l2")]


@pytest.mark.parametrize(
    ("body", "views"),
    [
        ('{"numVisits": 12}', 12), ('{"a": [{"num_visits_str": "1.234"}], "views": 9}', 1234), ('{"numVisits": 1, "x": {"numVisits": 2}}', None), ('{"data": {"view-count": 7, "deep": [{"Views": 7}]}}', 7),
        ('{"views": 7, "counter": 8}', None), ('{"count": 5, "value": 6}', None), ('{"views": true}', None), ("17", None), ("viewCount = 31", 31), ("", None), (None, None), ('{"views": 3.0}', 3), ('{"views": NaN}', None),
    ],
)
def test_payloads(body, views):
    assert vc.payload_counter(body)[0] == views


def test_counters_and_kinds(spark):
    rows = [
        ("<span id=\"viewad-cntr-num\">1.204</span>", "01.02.2026 Heute 14:30 0012345", "https://m.example/s-anzeige/x/123456789-1-2", 200),
        ("<h1>Anzeige nicht <b>mehr</b> verfügbar</h1>", "keine", "https://m.example/s-anzeige/x/123456789-1-2", 200),
        ("captcha", None, None, 403), (None, "", "https://m.example/s-anzeige/x/123456789-1-2", 410), ("<p>123456789</p>", "12 345", "https://m.example/s-anzeige/x/123456789-1-2", 200), ("<p>robot</p>", "1", "https://m.example/other", 500),
    ]
    df = spark.createDataFrame(rows, "html string, extra string, url string, status int")
    first = vc.first_counter(("html", vc.html_views(F.col("html"))), ("extra", vc.extra_views(F.col("extra"))))
    found = df.select(
        vc.html_views(F.col("html")), vc.extra_views(F.col("extra")), vc.text_views(F.col("extra")), first.alias("f"), vc.available(F.col("url"), F.col("status"), F.col("html"), F.lit(None).cast("string")),
        vc.document_kind(F.col("html")), vc.page_kind(F.col("html"), F.col("url")), vc.payload_views(F.lit('{"views": 5}')).alias("p"),
    ).collect()
    assert [r[0] for r in found] == [1204, None, None, None, None, None] and [r[1] for r in found] == [12345, None, None, None, 345, 1]
    assert [r[2] for r in found][3:] == [None, 12345, 1] and [tuple(r.f) for r in found][:2] == [(1204, "html"), (None, None)]
    assert [r[4] for r in found] == [None, False, None, False, True, None]
    assert [r[5] for r in found] == ["script", "script", "challenge", "script", "script", "script"]
    assert [r[6] for r in found] == ["normal", "normal", "challenge", "normal", "normal", "challenge"] and found[0].p.views == 5


def test_each_pattern_is_looked_for_once(spark):
    df = spark.createDataFrame([(1, "", 1, FEED)], "k int, html string, requested_page int, final_url string")
    plan = _plan(rp.pages(df, BASE, HOST))
    # Each of them once for the places and what stands alone, not for each place, nor again to see that it is not empty.
    assert plan.count(r"\bHeute") == plan.count(r"\bGestern") == plan.count(r"\d{1,2}\.\d{1,2}\.\d{4}") == 1
    assert plan.count("lower(_text") == 1 and plan.count(r"von\s") == 4
    # Cards and links are read out of the answer at once, so that no later step copies it.
    assert plan.count("_r#") <= 1


def test_pages_of_sound_tags_are_read_as_any_other(spark):
    from stallmetrics.sources import dom

    found = {k: v for k, v in CASES.items() if v[0]}
    assert all(dom._sound(v[0]) for v in found.values()) and not dom._sound("<p>a<!-- b --></p>") and not dom._sound("<template></template>") and not dom._sound("<p><b></p>")
    rows = [(k, html, n, url) for k, (html, n, url) in found.items()] + [(k, f"<!-- x -->{html}<p>", n, url) for k, (html, n, url) in found.items()]
    read = rp.pages(spark.createDataFrame(rows, "name string, html string, requested_page int, final_url string"), BASE, HOST).collect()
    assert len(read) == 2 * len(found) and len({(r["name"], str(r["info"])) for r in read}) == len(found)


def test_templates_have_no_text(spark):
    df = spark.createDataFrame([(1, card(1234567, more='<template><b class="price">9 €</b></template>'), 1, FEED)], "k int, html string, requested_page int, final_url string")
    assert [(r.title, r.price_eur) for r in rp.items(rp.pages(df, BASE, HOST), "k").collect()] == [("Normal", 15)]


def test_links_are_read_alike_and_not_kept():
    from stallmetrics.sources import dom

    page = dom.tree("".join(f'<a href="/s-anzeige/x/{i}-1-1">x</a><A href="/s-anzeige/x/{i}-1-2&amp;">y</A>' for i in range(50)))
    assert [t.attrs["href"] for t in page.tags[1:5]] == ["/s-anzeige/x/0-1-1", "/s-anzeige/x/0-1-2&", "/s-anzeige/x/1-1-1", "/s-anzeige/x/1-1-2&"]
    assert not any(k.startswith("a href") for k in dom._tags) and len({id(rp._found(t)) for t in page.tags[1:]}) == 1


def test_the_stride_is_guessed_once(spark):
    df = spark.createDataFrame([(1, "", 1, FEED)], "k int, html string, requested_page int, final_url string")
    plan = _plan(rp.pages(df, BASE, HOST))
    assert "bround(" not in plan and plan.count("rint(") == 1
