"""Captured pages and counter answers made from the derived relations (survey S1-S17, T20, X2, X3, A22): orders are pages, their lines cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import translate
from ..shared import shared_dir
from ..sources import export, result_pages, view_counters
from . import relations as R

_HOST = "market.example"
_BASE = f"https://www.{_HOST}"


def _c(name):
    return F.col(name)


def _captured(spark, sf):
    """A page's cards by their line: 1 plain, 2 promoted, 3 shipping before the price and a time element, 4 without date and price, 5 the first once more, 6 a date and a price that stand alone, 7 free and yesterday."""
    o = R.offers(spark, sf)
    line, price = _c("l_linenumber"), F.concat(F.translate(F.format_number("price_eur", 0), ",", "."), F.lit(" €"))
    number = F.when(line == 5, _c("ordinal") - 4).otherwise(_c("ordinal")) + 1_000_000
    day = F.concat(F.lit('<div class="aditem-main--top--right">Heute, 10:0'), line, F.lit("</div>"))
    date = F.when(line == 3, '<time datetime="1998-05-03T10:00">May</time>').when(line == 4, "").when(line == 6, "<div><small> 15.06.1998 </small></div>").when(line == 7, '<b title="Gestern, 9:30">x</b>').otherwise(day)
    said = (
        F.when(line == 3, F.concat(F.lit("<p>+ Versand ab 1,49 €</p><p>"), price, F.lit("</p>"))).when(line == 4, "").when(line == 6, F.concat(F.lit("<em>nur "), price, F.lit(" Festpreis</em>"))).when(line == 7, '<span data-testid="price">Zu verschenken</span>')
        .otherwise(F.concat(F.lit('<div class="aditem-main--middle--price-shipping--price">'), price, F.lit(" VB</div>")))
    )
    card = F.concat(F.when(line == 2, '<li class="ad-listitem is-topad">').otherwise('<li class="ad-listitem">'), F.lit('<a href="/s-anzeige/x/'), number.cast("string"), F.lit('-79-1"><h2>'), _c("title"), F.lit(" &amp; mehr</h2></a>"), date, said, F.lit("</li>"))
    pages = o.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(line.alias("line"), card.alias("card")))).alias("cards"))
    n = (_c("l_orderkey") % 5 + 1).cast("int")
    span = F.concat(F.lit("<p>"), (n * 25 - 24).cast("string"), F.lit(" - "), (n * 25).cast("string"), F.lit(" von 1.234</p>"))
    html = F.concat(F.when(_c("l_orderkey") % 9 == 0, "<h1>Captcha</h1>").otherwise(span), F.array_join("cards.card", ""), F.lit('<ul><li><a href="/s-film/ulm/c79l2">Ulm</a> (1.200)</li><li><a href="/s-film/bonn/c79l3">Bonn</a> (7)</li></ul>'))
    address = F.concat(F.lit(f"{_BASE}/s-film/"), F.when(n > 1, F.concat(F.lit("seite:"), n.cast("string"), F.lit("/"))).otherwise(""), F.lit("c79"))
    return pages.select("l_orderkey", html.alias("html"), n.alias("requested_page"), address.alias("final_url"))


def captured_items(spark, sf):
    found = result_pages.items(result_pages.pages(_captured(spark, sf), _BASE, _HOST), "l_orderkey")
    return found.select("l_orderkey", "ordinal", "external_id", "title", "price_text", "price_eur", "posted_text")


def captured_pages(spark, sf):
    found = result_pages.pages(_captured(spark, sf), _BASE, _HOST).select("l_orderkey", "info.*")
    return found.select(
        "l_orderkey", F.size("items").alias("items"), "result_start", "total_results", "actual_page", "max_page", "stride", "request_matches_page", "page_verified", "fingerprint", "raw_candidates", "promoted_filtered", F.size("promoted_ids").alias("promoted_ids"), "duplicate_cards",
        "missing_date_count", "missing_price_count", F.round("date_coverage", 6).alias("date_coverage"), "suspicious", "low_coverage", F.array_join(F.transform("location_shards", lambda s: s["count"].cast("string")), ",").alias("shards"),
    )


def counter_answers(spark, sf):
    """JSON answers and pages that tell a counter, by the remainder of the line."""
    o = R.offers(spark, sf).filter("view_count IS NOT NULL")
    n, line = _c("view_count").cast("string"), _c("l_linenumber")
    body = (
        F.when(line == 1, F.concat(F.lit('{"numVisits":"'), n, F.lit('"}'))).when(line == 2, F.concat(F.lit('{"a":[{"view-count":'), n, F.lit("}]}"))).when(line == 3, F.concat(F.lit('{"numVisits":'), n, F.lit(',"x":{"numVisitsStr":"99999"}}')))
        .when(line == 4, F.concat(F.lit("views = "), n, F.lit(";"))).when(line == 5, '{"views":true,"count":7}').otherwise("no json")
    )
    html = F.when(line == 6, F.concat(F.lit('<span id="viewad-cntr-num"> <b>'), n, F.lit("</b></span>"))).otherwise("<p></p>")
    shown = F.concat(F.lit("am 03.05.1998 um 10:15 "), n, F.lit(" mal"))
    rows = o.select("external_id", view_counters.payload_views(body).alias("json"), html.alias("html"), shown.alias("shown"))
    first = view_counters.first_counter(("json", _c("json.views")), ("html", view_counters.html_views(_c("html"))), ("text", view_counters.extra_views(_c("shown"))))
    return rows.select("external_id", _c("json.source").alias("json_source"), view_counters.text_views(F.regexp_replace("shown", "^am .* um .{5} ", "")).alias("text_views"), first["views"].alias("views"), first["source"].alias("source"))


def availability(spark, sf):
    o = R.offers(spark, sf)
    line = _c("l_linenumber")
    url = F.concat(F.lit(f"{_BASE}/s-anzeige/x/"), (_c("ordinal") + 1_000_000).cast("string"), F.lit("-1-2"))
    status = F.when(line == 1, 404).when(line == 2, 503).otherwise(200)
    html = F.when(line == 3, "<p>Die gewünschte\n Anzeige ist nicht mehr verfügbar</p>").when(line == 4, F.concat(F.lit("<p>Nr. "), (_c("ordinal") + 1_000_000).cast("string"), F.lit("</p>"))).when(line == 5, "<p>Captcha</p>").otherwise(F.concat(F.lit("<p>"), F.repeat(F.lit("w "), 200), F.lit("</p>")))
    final = F.when(line == 6, url).otherwise(F.lit(f"{_BASE}/s-home"))
    body = F.when(line == 7, "Cookie zustimmen").otherwise(html)
    return o.select("external_id", view_counters.available(url, status, html, final).alias("available"), view_counters.document_kind(html).alias("document"), view_counters.page_kind(body, final).alias("page"))


def exported_listings(spark, sf):
    """The listings of complete scans, written by the export and read back by its manifest."""
    import uuid

    o = R.offers(spark, sf)
    listings = o.select(_c("l_orderkey").alias("scan_id"), "external_id", F.concat("title", F.lit(', "neu"')).alias("title"), "price_eur", "view_count", F.concat(F.lit("u/"), "external_id").alias("url"), F.lit("Heute").alias("posted_text"))
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    export.export(listings, R.scans(spark, sf), path)
    return export.exported(spark, path)


_PHRASES = {"Скан готов": "Scan is ready", "Скан": "Scan", "готов": "ready", "→ цена": "→ price"}
_WORDS = {"страница": "page", "заказ": "order"}


def translated_texts(spark, sf):
    o = R.table(spark, sf, "orders")
    n = _c("o_orderkey").cast("string")
    said = F.when(_c("o_orderkey") % 3 == 0, F.concat(F.lit("Скан готов: Заказ "), n)).when(_c("o_orderkey") % 3 == 1, F.concat(F.lit("Скан, неготов → цена "), n, F.lit(" стр"))).otherwise(F.concat(F.lit("Страница "), n, F.lit("мин")))
    to = F.when(_c("o_custkey") % 4 == 0, "ru").otherwise("EN ")
    return o.select("o_orderkey", translate.translated(said, to, _PHRASES, _WORDS).alias("text"))


QUERIES = {f.__name__: f for f in (captured_items, captured_pages, counter_answers, availability, exported_listings, translated_texts)}

_EURO = "replace(format('{:,}', price_eur), ',', '.') || ' €'"
_CARDS = f"""cards AS (SELECT *, CAST(CASE WHEN l_linenumber = 5 THEN ordinal - 4 ELSE ordinal END + 1000000 AS VARCHAR) AS id, title || ' & mehr' AS t, {_EURO} AS e FROM offers),
  kept AS (SELECT * FROM cards WHERE l_linenumber <> 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey, id ORDER BY l_linenumber) = 1)"""
_POSTED = "CASE l_linenumber WHEN 3 THEN '1998-05-03T10:00' WHEN 4 THEN NULL WHEN 6 THEN '15.06.1998' WHEN 7 THEN 'Gestern, 9:30' ELSE 'Heute, 10:0' || l_linenumber END"
_PRICED = "CASE l_linenumber WHEN 3 THEN e WHEN 4 THEN NULL WHEN 6 THEN e || ' Festpreis' WHEN 7 THEN 'Zu verschenken' ELSE e || ' VB' END"

SQL = {
    "captured_items": f"""WITH {R.OFFERS}, {_CARDS} SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS ordinal, id AS external_id, t AS title, {_PRICED} AS price_text,
      CASE WHEN l_linenumber NOT IN (4, 7) THEN price_eur END AS price_eur, {_POSTED} AS posted_text FROM kept""",
    "captured_pages": f"""WITH {R.OFFERS}, {_CARDS}, k AS (SELECT l_orderkey, count(*) AS items, count(*) FILTER (l_linenumber = 4) AS lacking, string_agg(id, '|' ORDER BY l_linenumber) AS print FROM kept GROUP BY 1),
      p AS (SELECT l_orderkey, CAST(l_orderkey % 5 + 1 AS INTEGER) AS n, l_orderkey % 9 = 0 AS bad, count(*) AS raw, count(*) FILTER (l_linenumber = 2) AS promoted, count(DISTINCT CASE WHEN l_linenumber <> 2 THEN id END) AS own, count(*) FILTER (l_linenumber <> 2) AS plain FROM cards GROUP BY 1)
      SELECT l_orderkey, CAST(coalesce(items, 0) AS INTEGER) AS items, CASE WHEN NOT bad THEN CAST(n * 25 - 24 AS BIGINT) END AS result_start, CASE WHEN NOT bad THEN CAST(1234 AS BIGINT) END AS total_results, CASE WHEN n > 1 THEN n WHEN NOT bad THEN 1 END AS actual_page, CASE WHEN NOT bad THEN 50 END AS max_page, 25 AS stride,
        true AS request_matches_page, true AS page_verified, coalesce(print, '') AS fingerprint, CAST(raw AS INTEGER) AS raw_candidates, CAST(promoted AS INTEGER) AS promoted_filtered, CAST(promoted AS INTEGER) AS promoted_ids, CAST(plain - own AS INTEGER) AS duplicate_cards,
        CAST(coalesce(lacking, 0) AS INTEGER) AS missing_date_count, CAST(coalesce(lacking, 0) AS INTEGER) AS missing_price_count, CASE WHEN coalesce(items, 0) > 0 THEN round((items - lacking) / items, 6) ELSE 0.0 END AS date_coverage, bad AS suspicious, coalesce((items - lacking) / items < 0.2, false) AS low_coverage, '7,1200' AS shards
      FROM p LEFT JOIN k USING (l_orderkey)""",
    "counter_answers": f"""WITH {R.OFFERS} SELECT external_id, CASE l_linenumber WHEN 1 THEN 'json-official:$.numVisits' WHEN 2 THEN 'json-explicit:$.a[0].view-count' WHEN 3 THEN 'json-official-conflict' WHEN 4 THEN 'text:views' END AS json_source, CAST(view_count AS BIGINT) AS text_views, CAST(view_count AS BIGINT) AS views,
      CASE WHEN l_linenumber IN (1, 2, 4) THEN 'json' WHEN l_linenumber = 6 THEN 'html' ELSE 'text' END AS source FROM offers WHERE view_count IS NOT NULL""",
    "availability": f"""WITH {R.OFFERS} SELECT external_id, CASE l_linenumber WHEN 1 THEN false WHEN 3 THEN false WHEN 4 THEN true WHEN 6 THEN true END AS available, CASE WHEN l_linenumber = 5 THEN 'challenge' WHEN l_linenumber IN (3, 4) THEN 'script' ELSE 'page' END AS document,
      CASE l_linenumber WHEN 5 THEN 'challenge' WHEN 6 THEN 'normal' WHEN 7 THEN 'consent-only' ELSE 'redirected' END AS page FROM offers""",
    "exported_listings": f"""WITH {R.OFFERS} SELECT l_orderkey AS scan_id, external_id, title || ', "neu"' AS title, price_eur, view_count, 'u/' || external_id AS url, 'Heute' AS posted_text FROM offers WHERE l_orderkey % 7 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "translated_texts": """SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'Скан готов: Заказ ' || o_orderkey WHEN 1 THEN 'Скан, неготов → цена ' || o_orderkey || ' стр' ELSE 'Страница ' || o_orderkey || 'мин' END
      ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Scan is ready: Order ' || o_orderkey WHEN 1 THEN 'Scan, неготов → price ' || o_orderkey || ' pages' ELSE 'Page ' || o_orderkey || ' min' END END AS text FROM orders""",
}
