"""Chronology, queues, administration and text functions over the derived relations (survey 2.3-2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, timeparse
from ..operators import admin, chronology, filters
from . import relations as R

_TARGET = "1998-06-15"


def _page_items(spark, sf):
    """Items of result pages: an order is a page, its lines' ship dates (some missing) the days."""
    o = R.offers(spark, sf)
    return o.select((F.col("l_orderkey") % 40).alias("feed"), (F.floor(F.col("l_orderkey") / 40) % 30 + 1).cast("int").alias("page"), F.when(F.col("quantity") % 5 != 0, F.to_date(F.date_add(F.lit("1998-06-25").cast("date"), (-(F.floor(F.col("l_orderkey") / 40) % 30) + F.col("l_linenumber") % 3 - 1).cast("int")))).alias("day"))


def page_chronology(spark, sf):
    found = chronology.page_profile(_page_items(spark, sf), F.lit(_TARGET).cast("date"), ["feed", "page"])
    return found.select("feed", "page", "items", "dated", "target_count", "newer", "older", "relation", F.round("coverage", 6).alias("coverage"), F.round("confidence", 6).alias("confidence"))


def date_boundary(spark, sf):
    pages = chronology.page_profile(_page_items(spark, sf), F.lit(_TARGET).cast("date"), ["feed", "page"])
    return chronology.boundary(pages, ["feed"])


def predicted_page(spark, sf):
    o = R.table(spark, sf, "orders")
    feed, day = (F.col("o_custkey") % 50).alias("feed"), F.to_date("o_orderdate")
    # Each day's page is predicted from the days around it, its own left out.
    points = o.select(feed, day.alias("day"), (50 - F.dayofyear("o_orderdate") % 50).alias("page"), F.col("o_orderkey").alias("confirmed_at"))
    targets = o.select(feed, day.alias("target")).distinct()
    return chronology.predicted_page(points, targets, ["feed"], own=False)


def url_shards(spark, sf):
    return chronology.shards(R.offers(spark, sf).select("l_orderkey", "external_id", "ordinal"), ["ordinal"], 3, ["l_orderkey"]).select("external_id", "shard")


def fair_round(spark, sf):
    queue = R.offers(spark, sf).select("l_orderkey", "external_id", "ordinal")
    return chronology.fair_round(queue, "l_orderkey", ["ordinal"], 120).select("l_orderkey", "external_id", "turn")


def prefetch(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 50).cast("int").alias("current"), (F.col("o_custkey") % 60).cast("int").alias("last"))
    found = o.withColumn("r", chronology.prefetch_range(F.col("current"), F.col("last"), F.lit(50)))
    return found.select("o_orderkey", F.col("r.start").alias("first_page"), F.col("r.end").alias("last_page"))


def _users(spark, sf):
    c = R.table(spark, sf, "customer")
    at = lambda n: F.lit(R.AS_OF).cast("timestamp") + F.make_dt_interval(hours=n)
    return c.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("first_name"), (F.col("c_nationkey") == 3).alias("is_banned"),
        F.when(F.col("c_custkey") % 9 != 0, at((F.col("c_custkey") % 100 - 50).cast("int"))).alias("access_until"), at((-(F.col("c_custkey") % 70)).cast("int")).alias("last_seen_at"), at((-(F.col("c_custkey") % 1000)).cast("int")).alias("joined_at"),
        at((F.col("c_custkey") % 1000).cast("int")).alias("created_at"), F.when(F.col("c_custkey") % 2 == 0, at((F.col("c_custkey") % 100 - 50).cast("int"))).alias("expiring_sent_for"), F.lit(None).cast("timestamp").alias("expired_sent_for"),
    )


_USERS = f"""users AS (SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS first_name, c_nationkey = 3 AS is_banned,
  CASE WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '{R.AS_OF}' + to_hours(c_custkey % 100 - 50) END AS access_until, TIMESTAMP '{R.AS_OF}' - to_hours(c_custkey % 70) AS last_seen_at,
  TIMESTAMP '{R.AS_OF}' - to_hours(c_custkey % 1000) AS joined_at, TIMESTAMP '{R.AS_OF}' + to_hours(c_custkey % 1000) AS created_at,
  CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '{R.AS_OF}' + to_hours(c_custkey % 100 - 50) END AS expiring_sent_for FROM customer)"""
_T = f"TIMESTAMP '{R.AS_OF}'"


def admin_stats(spark, sf):
    s = R.scans(spark, sf)
    payments = s.select(F.when(F.col("status") == "done", "paid").when(F.col("status") == "queued", "pending").otherwise("expired").alias("status"), F.col("amount"), F.col("finished_at").alias("paid_at"))
    out = admin.admin_stats(_users(spark, sf), s.withColumn("created_at", F.col("finished_at")), payments, R.as_of())
    return out.withColumns({"paid_total": F.round("paid_total", 2), "paid_24h": F.round("paid_24h", 2)})


def user_payments(spark, sf):
    p = R.scans(spark, sf).select("user_id", F.col("scan_id").alias("payment_id"), "amount", F.col("finished_at").alias("created_at"))
    return admin.user_payments(p, 3).select("user_id", "payment_id", "amount", "place")


def notices(spark, sf):
    return filters.notices(_users(spark, sf), R.as_of()).select("user_id", "notice")


def access(spark, sf):
    u = _users(spark, sf)
    return u.select("user_id", filters.has_access("subscription", F.col("user_id") < 5, F.col("is_banned"), F.col("access_until"), R.as_of()).alias("allowed"), admin.extended_access(F.col("access_until"), F.lit(30), R.as_of()).cast("timestamp_ntz").alias("extended_until"))


def user_search(spark, sf):
    return filters.find_users(_users(spark, sf), "11", 50).select("user_id", "username")


def invoice_match(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, "usdt").otherwise("EUR").alias("currency"), "o_totalprice", (F.col("o_totalprice") + (F.col("o_orderkey") % 3) * 0.0007).alias("paid"))
    return o.select("o_orderkey", filters.invoice_matches(F.col("currency"), F.col("paid"), F.col("o_totalprice")).alias("matches"))


def live_workers(spark, sf):
    beats = R.table(spark, sf, "events").select(F.col("event_type").alias("role"), F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("beat_at"), F.lit(1).alias("done"))
    return admin.live_totals(beats, R.as_of("2024-01-20 00:00:00"), ["done"], 3600)


def scan_quality(spark, sf):
    o = R.offers(spark, sf)
    pages = o.select((F.col("l_orderkey") % 500).alias("scan_id"), (F.col("l_orderkey") % 7).alias("page"), F.col("ordinal").alias("attempt"), (F.col("quantity") % 6 != 0).alias("verified"), (F.col("price_eur") % 11 == 0).alias("suspicious"), F.col("l_linenumber").alias("items"))
    return admin.scan_quality(pages)


def parsed_values(spark, sf):
    o = R.offers(spark, sf)
    shown = F.concat(F.lit("Preis "), F.regexp_replace(F.format_number("price_eur", 0), ",", "."), F.lit(" € VB"))
    url = F.concat(F.lit("https://www.market.example/s-anzeige/x/"), (F.col("ordinal") + 1_000_000).cast("string"), F.lit("-12-34"))
    feed = F.concat(F.lit("https://www.market.example/s-dinge/c"), (F.col("l_orderkey") % 100).cast("string"))
    return o.select(
        "external_id", text.parse_price(shown).alias("price"), text.external_id(url).alias("ad_id"), text.page_url(feed, F.col("l_linenumber")).alias("page_url"), text.private_url(feed).alias("private_url"),
        text.hash_id(24, "category", "external_id").alias("hash_id"), text.allowed_url(url, "market.example").alias("allowed"), text.grouped_int(shown).alias("first_int"),
    )


def posted_times(spark, sf):
    e = R.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    clock = F.date_format("at", "HH:mm")
    shown = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Heute, "), clock)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Gestern, "), clock)).otherwise(F.date_format("at", "dd.MM.yyyy, HH:mm"))
    rows = e.select("event_id", shown.alias("shown"), F.lit("2024-02-10 22:30:00").cast("timestamp").alias("moment"))
    return timeparse.with_posted(rows, "shown", "moment").select("event_id", F.round("age_minutes", 3).alias("age_minutes"), "day_moscow")


def json_counter(spark, sf):
    e = R.table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("counter"))


def canonical_titles(spark, sf):
    rows = R.offers(spark, sf).select("category", "title").distinct().withColumn("fold", text.folded("title"))
    rows = rows.withColumn("normal", text.normalize_title(F.col("fold"))).withColumn("words", text.identity_words(F.col("fold")))
    fam = text.family_of(F.col("words"))
    return rows.select("category", "title", "normal", fam["key"].alias("family_key"), fam["confidence"].alias("confidence"), text.opportunity_family(F.col("fold"), F.col("category")).alias("opportunity_key"), text.slug(F.col("fold")).alias("slug"))


QUERIES = {f.__name__: f for f in (page_chronology, date_boundary, predicted_page, url_shards, fair_round, prefetch, admin_stats, user_payments, notices, access, user_search, invoice_match, live_workers, scan_quality, parsed_values, posted_times, json_counter, canonical_titles)}

_ITEMS = "items AS (SELECT l_orderkey % 40 AS feed, CAST(l_orderkey // 40 % 30 + 1 AS INTEGER) AS page, CASE WHEN quantity % 5 <> 0 THEN DATE '1998-06-25' + CAST(-(l_orderkey // 40 % 30) + l_linenumber % 3 - 1 AS INTEGER) END AS day FROM offers)"
_PROFILE = f"""cnt AS (SELECT feed, page, count(*) AS items, count(day) AS dated, count(*) FILTER (WHERE day = DATE '{_TARGET}') AS target_count, count(*) FILTER (WHERE day > DATE '{_TARGET}') AS newer, count(*) FILTER (WHERE day < DATE '{_TARGET}') AS older FROM items GROUP BY 1, 2),
  prof AS (SELECT *, dated / items AS coverage, greatest(newer, older) / (newer + older) AS dom, CASE WHEN dated = 0 THEN 'unknown' WHEN target_count > 0 THEN 'target' WHEN dated < least(2, items) THEN 'unknown' WHEN older = 0 THEN 'newer' WHEN newer = 0 THEN 'older'
    WHEN greatest(newer, older) / (newer + older) >= 0.7 THEN CASE WHEN newer > older THEN 'newer' ELSE 'older' END ELSE 'mixed' END AS relation FROM cnt)"""



def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _spelled(column: str, rules) -> str:
    """The column with spellings replaced, in SQL."""
    for pattern, by in rules:
        column = f"regexp_replace({column}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return column


_MODEL = f"w IN ({_in(text.ROOTS + text.VARIANTS + text.TYPES)}) OR regexp_matches(w, '[0-9]')"

SQL = {
    "page_chronology": f"""WITH {R.OFFERS}, {_ITEMS}, {_PROFILE} SELECT feed, page, items, dated, target_count, newer, older, relation, round(coverage, 6) AS coverage, round(CASE WHEN dated = 0 THEN 0 WHEN target_count > 0 THEN least(1, greatest(0.35, coverage, target_count / dated))
      WHEN dated < least(2, items) THEN greatest(0.1, coverage * 0.5) WHEN newer = 0 OR older = 0 THEN greatest(0.35, coverage) WHEN dom >= 0.7 THEN greatest(0.30, coverage * dom) ELSE greatest(0.25, coverage * dom) END, 6) AS confidence FROM prof""",
    "date_boundary": f"""WITH {R.OFFERS}, {_ITEMS}, {_PROFILE}, a AS (SELECT feed, min(page) FILTER (WHERE relation = 'target') AS t, max(page) FILTER (WHERE relation = 'newer') AS ln, bool_or(page = 1 AND relation IN ('older', 'mixed', 'empty')) AS once,
        count(*) FILTER (WHERE relation IN ('older', 'mixed', 'empty')) AS nn FROM prof GROUP BY 1),
      b AS (SELECT a.*, (SELECT max(page) FROM prof p WHERE p.feed = a.feed AND relation = 'newer' AND page < a.t) AS bt, (SELECT min(page) FROM prof p WHERE p.feed = a.feed AND relation IN ('target', 'older', 'mixed', 'empty') AND page > a.ln) AS ab FROM a)
      SELECT feed, CASE WHEN t IS NOT NULL THEN coalesce(bt, 0) WHEN once THEN 0 WHEN ab IS NOT NULL THEN ln END AS low, CASE WHEN t IS NOT NULL THEN t WHEN once THEN 1 ELSE ab END AS high,
        CASE WHEN t IS NOT NULL THEN 'done' WHEN ln IS NOT NULL AND nn = 0 THEN 'right' WHEN ln IS NULL AND nn > 0 THEN 'left' ELSE 'both' END AS direction FROM b""",
    "predicted_page": """WITH p AS (SELECT o_custkey % 50 AS feed, CAST(o_orderdate AS DATE) AS day, arg_max(50 - dayofyear(o_orderdate) % 50, o_orderkey) AS page FROM orders GROUP BY 1, 2),
      t AS (SELECT DISTINCT o_custkey % 50 AS feed, CAST(o_orderdate AS DATE) AS target FROM orders),
      n AS (SELECT t.feed, target, day, page FROM (SELECT *, unnest([-6, -5, -4, -3, -2, -1, 1, 2, 3, 4, 5, 6]) AS k FROM t) t JOIN p ON p.feed = t.feed AND p.day = t.target + CAST(k AS INTEGER) QUALIFY row_number() OVER (PARTITION BY t.feed, target ORDER BY abs(day - target), day) <= 2),
      l AS (SELECT feed, target, min(day) AS d1, arg_min(page, day) AS p1, max(day) AS d2, arg_max(page, day) AS p2, max(page) FILTER (WHERE day = target) AS exact FROM n GROUP BY 1, 2),
      s AS (SELECT *, (p2 - p1) / nullif(d2 - d1, 0) AS slope FROM l)
      SELECT feed, target, CAST(CASE WHEN exact IS NOT NULL THEN least(50, greatest(1, exact)) ELSE least(50, greatest(1, round_even(p1 + slope * (target - d1), 0))) END AS INTEGER) AS page,
        CASE WHEN exact IS NOT NULL THEN 'exact' WHEN target BETWEEN d1 AND d2 THEN 'interpolated' ELSE 'extrapolated' END AS source FROM s WHERE exact IS NOT NULL OR (slope < -0.25 AND slope >= -50)""",
    "url_shards": f"WITH {R.OFFERS} SELECT external_id, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY ordinal) - 1) % 3 AS INTEGER) AS shard FROM offers",
    "fair_round": f"WITH {R.OFFERS} SELECT l_orderkey, external_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY ordinal) AS INTEGER) AS turn FROM offers ORDER BY turn, l_orderkey LIMIT 120",
    "prefetch": """WITH x AS (SELECT o_orderkey, CAST(greatest(1, o_orderkey % 50) AS INTEGER) AS c, CAST(o_custkey % 60 AS INTEGER) AS l FROM orders), y AS (SELECT *, greatest(c + 1, l + 1) AS a, least(50, c + 10) AS b FROM x)
      SELECT o_orderkey, CASE WHEN c < 50 AND NOT (l > c AND l - c > 4) AND a <= b THEN a END AS first_page, CASE WHEN c < 50 AND NOT (l > c AND l - c > 4) AND a <= b THEN b END AS last_page FROM y""",
    "admin_stats": f"""WITH {R.SCANS}, {_USERS}, u AS (SELECT count(*) AS total_users, count(*) FILTER (WHERE NOT is_banned AND access_until > {_T}) AS active_users, count(*) FILTER (WHERE last_seen_at >= {_T} - INTERVAL 24 HOUR) AS active_24h, count(*) FILTER (WHERE joined_at >= {_T} - INTERVAL 24 HOUR) AS new_24h FROM users),
      s AS (SELECT count(*) AS total_scans, count(*) FILTER (WHERE finished_at >= {_T} - INTERVAL 24 HOUR) AS scans_24h, count(*) FILTER (WHERE status = 'queued') AS pending_payments, count(*) FILTER (WHERE status = 'done') AS paid_count, round(coalesce(sum(amount) FILTER (WHERE status = 'done'), 0), 2) AS paid_total,
        round(coalesce(sum(amount) FILTER (WHERE status = 'done' AND finished_at >= {_T} - INTERVAL 24 HOUR), 0), 2) AS paid_24h FROM scans) SELECT * FROM u, s""",
    "user_payments": "SELECT o_custkey AS user_id, o_orderkey AS payment_id, o_totalprice AS amount, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders QUALIFY place <= 3",
    "notices": f"""WITH {_USERS} SELECT user_id, CASE WHEN access_until > {_T} THEN 'expiring' ELSE 'expired' END AS notice FROM users WHERE NOT is_banned AND
      ((access_until > {_T} AND access_until <= {_T} + INTERVAL 24 HOUR AND expiring_sent_for IS DISTINCT FROM access_until) OR (access_until <= {_T} AND access_until >= {_T} - INTERVAL 24 HOUR))""",
    "access": f"WITH {_USERS} SELECT user_id, CASE WHEN user_id < 5 THEN true WHEN is_banned THEN false ELSE coalesce(access_until > {_T}, false) END AS allowed, greatest(coalesce(access_until, {_T}), {_T}) + INTERVAL 30 DAY AS extended_until FROM users",
    "user_search": f"WITH {_USERS} SELECT user_id, username FROM users WHERE username ILIKE '%11%' OR first_name ILIKE '%11%' OR user_id = 11 ORDER BY created_at DESC, user_id LIMIT 50",
    "invoice_match": "SELECT o_orderkey, o_orderkey % 4 <> 0 AND abs(CAST(o_totalprice + (o_orderkey % 3) * 0.0007 AS DECIMAL(18, 6)) - CAST(o_totalprice AS DECIMAL(18, 6))) <= 0.001 AS matches FROM orders",
    "live_workers": "SELECT event_type AS role, count(DISTINCT user_id) AS workers, count(*) AS done FROM events WHERE ts >= TIMESTAMP '2024-01-19 23:00:00' GROUP BY 1",
    "scan_quality": f"""WITH {R.OFFERS}, p AS (SELECT l_orderkey % 500 AS scan_id, l_orderkey % 7 AS page, arg_max(quantity % 6 <> 0 AND price_eur % 11 <> 0, ordinal) AS good, arg_max(l_linenumber, ordinal) AS items, count(*) AS attempts FROM offers GROUP BY 1, 2)
      SELECT scan_id, count(*) AS pages, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) FILTER (WHERE good) AS good_pages, CAST(sum(items) AS BIGINT) AS items, CAST(round_even(100 * avg(CAST(good AS INTEGER)), 0) AS INTEGER) AS quality FROM p GROUP BY 1""",
    "parsed_values": f"""WITH {R.OFFERS} SELECT external_id, price_eur AS price, CAST(ordinal + 1000000 AS VARCHAR) AS ad_id, 'https://www.market.example/s-dinge/' || CASE WHEN l_linenumber > 1 THEN 'seite%3A' || l_linenumber || '/' ELSE '' END || 'c' || l_orderkey % 100 AS page_url,
      'https://www.market.example/s-dinge/anbieter%3Aprivat/c' || l_orderkey % 100 AS private_url, substr(sha1(category || '|' || external_id), 1, 24) AS hash_id, true AS allowed, CAST(price_eur AS BIGINT) AS first_int FROM offers""",
    "posted_times": """WITH x AS (SELECT event_id, event_id % 3 AS k, ts, strftime(ts, '%H:%M')::TIME AS clock FROM events),
      y AS (SELECT event_id, k, CASE k WHEN 0 THEN DATE '2024-02-10' + clock WHEN 1 THEN DATE '2024-02-09' + clock ELSE date_trunc('minute', ts) END AS berlin, CAST(ts AS DATE) AS d FROM x)
      SELECT event_id, greatest(round((epoch_us(TIMESTAMP '2024-02-10 22:30:00') - epoch_us(berlin - INTERVAL 1 HOUR)) / 6e7, 3), 0) AS age_minutes,
        CASE WHEN k = 2 THEN d ELSE CAST(berlin + INTERVAL 2 HOUR AS DATE) END AS day_moscow FROM y""",
    "json_counter": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS counter FROM events",
    "canonical_titles": f"""WITH {R.OFFERS}, t AS (SELECT DISTINCT category, title, strip_accents(lower(replace(replace(title, 'ß', 'ss'), 'ẞ', 'ss'))) AS fold FROM offers),
      c AS (SELECT *, trim(regexp_replace({_spelled("fold", text.SPELLINGS)}, '[^a-z0-9]+', ' ', 'g')) AS canon, trim(regexp_replace(replace({_spelled("fold", text.IDENTITY_SPELLINGS)}, '+', ' plus '), '\\s+', ' ', 'g')) AS ident FROM t),
      w AS (SELECT *, list_filter(string_split(canon, ' '), lambda w: w <> '' AND w NOT IN ({_in(text.STOPWORDS)})) AS words, list_filter(regexp_extract_all(ident, '[a-z0-9]+(?:-[a-z0-9]+)*'), lambda w: length(w) >= 2 AND w NOT IN ({_in(text.FAMILY_STOPWORDS)})) AS tokens FROM c),
      i0 AS (SELECT *, list_filter(words, lambda w: w NOT IN ({_in(text.COLORS + text.CONDITIONS)}) AND NOT regexp_matches(w, '^\\d+x$')) AS plain FROM w),
      i AS (SELECT *, list_filter(plain, lambda w: NOT ({" OR ".join(f"(w = '{b}' AND list_has_any(plain, [{_in(r.split())}]))" for b, r in text.ROOTS_OF_BRAND.items())})) AS idw FROM i0),
      p AS (SELECT *, list_filter(idw, lambda w: {_MODEL}) AS models, list_filter(idw, lambda w: w IN ({_in(text.BRANDS)})) AS brands, list_filter(idw, lambda w: NOT ({_MODEL}) AND w NOT IN ({_in(text.BRANDS)})) AS other,
        list_filter(tokens, lambda w: regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, '^\\d+(?:gb|tb|v|w|kw|mah|ah|mm|cm|hz|kg)$')) AS codes, list_filter(tokens, lambda w: regexp_matches(w, '^[a-z]+$') AND length(w) >= 3) AS names FROM i),
      k AS (SELECT *, list_sort(list_distinct(CASE WHEN len(models) > 0 THEN list_concat(models, list_concat(brands[1:1], other[1:2])) ELSE list_concat(brands[1:1], other[1:5]) END)) AS key, list_sort(list_distinct(CASE WHEN len(codes) > 0 THEN codes[1:2] ELSE names[2:3] END)) AS tail FROM p)
      SELECT category, title, array_to_string(words, ' ') AS normal, array_to_string(key, ' ') AS family_key, CASE WHEN len(key) = 0 THEN 0 ELSE greatest(0, least(100, 25 + CASE WHEN list_has_any(key, [{_in(text.ROOTS)}]) THEN 35 ELSE 0 END + CASE WHEN len(list_filter(key, lambda w: regexp_matches(w, '[0-9]'))) > 0 THEN 20 ELSE 0 END
          + CASE WHEN list_has_any(key, [{_in(text.VARIANTS + text.TYPES)}]) THEN 10 ELSE 0 END + CASE WHEN len(key) >= 2 THEN 10 ELSE 0 END - CASE WHEN len(models) = 0 AND len(key) < 2 THEN 20 ELSE 0 END)) END AS confidence,
        CASE WHEN len(tail) > 0 THEN 'fam:' || coalesce(nullif(category, ''), 'unknown') || ':' || array_to_string(list_concat([coalesce(names[1], 'product')], tail), '|') ELSE '' END AS opportunity_key, trim(regexp_replace(ident, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM k""",
}
