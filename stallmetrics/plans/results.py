"""Result modes over the derived relations (survey 2.3, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, modes
from ..shared import stored
from . import relations as R

_SETTINGS = filters.Settings(price_filter="custom:200:1500", min_views=20, clean_noise=True, include_words="widget, bolt", exclude_words="brand 4")


def base_filter(spark, sf):
    return filters.base_filter(R.offers(spark, sf), _SETTINGS).select("external_id", "category", "title", "price_eur", "view_count")


_FILTERED = "price_eur BETWEEN 200 AND 1500 AND view_count >= 20 AND (' ' || normal || ' ' LIKE '% widget %' OR ' ' || normal || ' ' LIKE '% bolt %') AND NOT ' ' || normal || ' ' LIKE '% brand 4 %'"


def deduped_newest(spark, sf):
    rows = R.offers(spark, sf).withColumn("duplicate_key", F.struct("category", "normal", "price_eur"))
    s = filters.Settings(price_filter="500_plus", smart_dedupe=True, sort_mode="price_asc")
    return filters.apply_settings(rows, s).select("external_id", "category", "title", "price_eur", "posted_at")


def unique_families(spark, sf):
    s = filters.Settings(output_mode="unique", price_filter="custom:100:700")
    return filters.apply_settings(R.offers(spark, sf), s).select("external_id", "category", "family_key", "family_confidence")


def frequent_families(spark, sf):
    return modes.frequent(R.offers(spark, sf))


def below_market(spark, sf):
    return modes.below_market(stored(R.offers(spark, sf).select("external_id", "category", "family_key", "price_eur"), "offers")).select("external_id", "category", "family_key", "price_eur", "median_price", "discount_pct", "samples")


def fast_disappearing(spark, sf):
    o = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("first_seen_at"))
    li = R.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("last_seen_at"), F.max("l_shipdate").alias("disappeared_at"))
    return modes.fast_disappearing(o.join(li, "l_orderkey"), 24 * 60).select("l_orderkey", "lifespan_minutes", "gap_minutes", "rank", "confidence")


def price_drop(spark, sf):
    rows = R.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("external_id"), "p_name", "p_type")
    found = modes.price_drops(rows, R.price_history(spark, sf))
    return found.orderBy(F.desc("drop_pct"), F.desc("drop_eur"), "external_id").select("external_id", "p_name", "p_type", "previous_price", "current_price", "drop_eur", "drop_pct", "changed_at")


def _snapshots(spark, sf):
    return R.offers(spark, sf).select(F.col("l_orderkey").alias("scan_id"), "external_id", "view_count", F.col("posted_at").alias("captured_at"))


def most_viewed(spark, sf):
    # Scans are orders; a category's latest has a few members.
    return modes.most_viewed(R.scans(spark, sf), _snapshots(spark, sf), 3).select("category", "scan_id", "external_id", "view_count", "place")


def growth_top(spark, sf):
    v = R.views(spark, sf).filter("id > 0").withColumn("target_hours", (F.col("id") * 8).cast("int")).withColumn("scan_id", F.split("external_id", ":")[0].cast("long"))
    return modes.growth(_snapshots(spark, sf), v.select("scan_id", "external_id", "view_count", "recorded_at", "target_hours"), 16, 2).select("scan_id", "external_id", "gain", "place", F.round("per_hour", 6).alias("per_hour"))


def refresh_summary(spark, sf):
    o = R.offers(spark, sf).select("category", F.col("quantity").alias("before"), F.col("view_count").alias("after"), (F.col("l_linenumber") % 2 == 0).alias("reused"))
    return modes.refresh_summary(o, ["category"])


def first_known(spark, sf):
    o = R.offers(spark, sf)
    o = o.select("external_id", F.when(F.col("l_linenumber") <= 3, F.col("view_count")).alias("official"), F.col("view_count").alias("page"), F.lit(None).cast("int").alias("network"))
    return modes.first_known(o, ["official", "page", "network"], "views").select("external_id", "views", "views_source")


QUERIES = {f.__name__: f for f in (base_filter, deduped_newest, unique_families, frequent_families, below_market, fast_disappearing, price_drop, most_viewed, growth_top, refresh_summary, first_known)}

SQL = {
    "base_filter": f"WITH {R.OFFERS} SELECT external_id, category, title, price_eur, view_count FROM offers WHERE {_FILTERED}",
    "deduped_newest": f"""WITH {R.OFFERS} SELECT external_id, category, title, price_eur, posted_at FROM offers WHERE price_eur >= 500
      QUALIFY row_number() OVER (PARTITION BY category, normal, price_eur ORDER BY posted_at DESC, ordinal) = 1""",
    "unique_families": f"""WITH {R.OFFERS} SELECT external_id, category, family_key, family_confidence FROM (SELECT *, count(*) OVER (PARTITION BY category, family_key) AS n FROM offers
      WHERE price_eur BETWEEN 100 AND 700) WHERE n = 1 AND family_confidence >= 35""",
    "frequent_families": f"""WITH {R.OFFERS} SELECT category, family_key, count(*) AS n, min(price_eur) FILTER (WHERE price_eur > 0) AS min_price,
      CAST(floor(quantile_cont(CAST(price_eur AS DOUBLE), 0.5) FILTER (WHERE price_eur > 0)) AS INTEGER) AS median_price, max(price_eur) FILTER (WHERE price_eur > 0) AS max_price,
      arg_min(family_confidence, ordinal) AS confidence, first(title ORDER BY posted_at DESC, ordinal) AS example_title, first(external_id ORDER BY posted_at DESC, ordinal) AS example_id
      FROM offers GROUP BY category, family_key HAVING count(*) >= 3""",
    "below_market": f"""WITH {R.OFFERS}, p AS (SELECT *, count(*) OVER (PARTITION BY category, family_key) AS samples FROM offers WHERE price_eur > 0),
      m AS (SELECT a.external_id, a.category, a.family_key, a.price_eur, a.samples, CAST(floor(quantile_cont(CAST(b.price_eur AS DOUBLE), 0.5)) AS INTEGER) AS median_price
        FROM p a JOIN p b ON a.category = b.category AND a.family_key = b.family_key AND a.external_id <> b.external_id WHERE a.samples >= 5 GROUP BY ALL)
      SELECT external_id, category, family_key, price_eur, median_price, CAST(round_even((1 - price_eur / median_price) * 100, 0) AS INTEGER) AS discount_pct, samples FROM m
      WHERE median_price > 0 AND NOT (median_price >= 50 AND price_eur < greatest(5, floor(median_price * 0.10))) AND 1 - price_eur / median_price >= 0.20""",
    "fast_disappearing": """WITH x AS (SELECT o_orderkey AS l_orderkey, greatest(CAST(floor(epoch_us(mx) / 6e7 - epoch_us(o_orderdate) / 6e7) AS BIGINT), 0) AS lifespan_minutes,
        greatest(CAST(floor(epoch_us(mx) / 6e7 - epoch_us(mn) / 6e7) AS BIGINT), 0) AS gap_minutes
        FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS mn, max(l_shipdate) AS mx FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey)
      SELECT *, CASE WHEN gap_minutes <= 30 THEN 0 WHEN gap_minutes <= 120 THEN 1 ELSE 2 END AS rank,
        CASE WHEN gap_minutes <= 30 THEN 'высокая' WHEN gap_minutes <= 120 THEN 'средняя' ELSE 'низкая' END AS confidence FROM x WHERE lifespan_minutes <= 86400""",
    "price_drop": f"""WITH {R.HISTORY}, r AS (SELECT *, lag(price_eur) OVER (PARTITION BY external_id ORDER BY recorded_at) AS previous_price FROM history WHERE price_eur > 0),
      l AS (SELECT * FROM r WHERE previous_price IS NULL OR previous_price <> price_eur QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY recorded_at DESC) = 1)
      SELECT external_id, p_name, p_type, previous_price, price_eur AS current_price, previous_price - price_eur AS drop_eur,
        CAST(round_even((previous_price - price_eur) / previous_price * 100, 0) AS INTEGER) AS drop_pct, recorded_at AS changed_at FROM l JOIN part ON CAST(p_partkey AS VARCHAR) = external_id
      WHERE previous_price - price_eur >= 5 AND round_even((previous_price - price_eur) / previous_price * 100, 0) >= 5""",
    "most_viewed": f"""WITH {R.OFFERS}, {R.SCANS}, l AS (SELECT category, scan_id FROM scans WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY category ORDER BY finished_at DESC, scan_id DESC) = 1)
      SELECT l.category, l.scan_id, external_id, view_count, CAST(row_number() OVER (PARTITION BY l.category ORDER BY view_count DESC, external_id) AS INTEGER) AS place
      FROM l JOIN offers ON offers.l_orderkey = l.scan_id WHERE view_count IS NOT NULL QUALIFY place <= 3""",
    "growth_top": f"""WITH {R.OFFERS}, {R.VIEWS}, g AS (SELECT o.l_orderkey AS scan_id, o.external_id, v.view_count - o.view_count AS gain, round((v.view_count - o.view_count) / 16.0, 6) AS per_hour
        FROM offers o JOIN views v ON v.external_id = o.external_id AND v.id = 2 WHERE o.view_count IS NOT NULL AND v.view_count > o.view_count)
      SELECT scan_id, external_id, gain, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY gain DESC, external_id) AS INTEGER) AS place, per_hour FROM g QUALIFY place <= 2""",
    "refresh_summary": f"""WITH {R.OFFERS}, x AS (SELECT category, view_count AS a, l_linenumber % 2 = 0 AS reused, greatest(view_count - quantity, 0) AS gain FROM offers)
      SELECT category, count(*) FILTER (WHERE a IS NOT NULL AND NOT reused) AS fresh, count(*) FILTER (WHERE a IS NOT NULL AND reused) AS reused_values, count(*) FILTER (WHERE a IS NULL) AS no_data,
        count(*) FILTER (WHERE a IS NOT NULL AND gain > 0) AS increased, max(CASE WHEN a IS NOT NULL THEN gain ELSE 0 END) AS max_growth, CAST(sum(CASE WHEN a IS NOT NULL THEN gain ELSE 0 END) AS BIGINT) AS total_growth FROM x GROUP BY 1""",
    "first_known": f"""WITH {R.OFFERS} SELECT external_id, view_count AS views, CASE WHEN view_count IS NULL THEN NULL WHEN l_linenumber <= 3 THEN 'official' ELSE 'page' END AS views_source FROM offers""",
}
