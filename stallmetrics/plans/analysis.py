"""Market profiles, scores and observations over the derived relations (survey 2.4-2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import market, observations, scoring
from ..shared import stored
from . import relations as R

_DAYS, _WINDOW = 360, 90


def _listings(spark, sf):
    return R.offers(spark, sf).withColumn("first_seen_at", F.col("posted_at").cast("timestamp"))


def _candidates(spark, sf, o=None):
    o = R.offers(spark, sf) if o is None else o
    outcome = F.when(F.col("price_eur") % 3 == 0, "confirmed").when(F.col("price_eur") % 3 == 1, "rejected").otherwise("pending")
    return o.select(F.col("family_key").alias("cohort_key"), F.col("posted_at").cast("timestamp").alias("created_at"), F.col("is_promoted").alias("is_control"), (F.col("price_eur") % 100).alias("current_score"), outcome.alias("outcome"), "external_id", "category")


def _offers(spark, sf):
    """The ads, written with what profiles and features read of them."""
    return stored(R.offers(spark, sf).select("external_id", "category", "family_key", "posted_at", "price_eur", "is_promoted", "view_count", "ordinal", "quantity", "l_linenumber"), "offers")


def _profiles(spark, sf, o=None):
    o = _offers(spark, sf) if o is None else o
    listings = o.withColumn("first_seen_at", F.col("posted_at").cast("timestamp"))
    views = R.views(spark, sf, o).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    return market.market_profile(listings.select("category", "family_key").distinct(), listings, views, _candidates(spark, sf, o), R.as_of(), _DAYS, _WINDOW)


def supply_profile(spark, sf):
    found = market.supply(_listings(spark, sf), R.as_of(), _DAYS, _WINDOW)
    return found.select("category", "family_key", "n", "median", "recent", "previous", F.round("supply_percentile", 6).alias("supply_percentile"), F.round("supply_growth_ratio", 6).alias("supply_growth_ratio"))


def demand_profile(spark, sf):
    views = R.views(spark, sf).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    ago = lambda n: R.as_of() - F.make_dt_interval(F.lit(n))
    return market.demand(views, _listings(spark, sf), ago(2 * _WINDOW), ago(_WINDOW)).select("family_key", F.round("rate", 6).alias("rate"), "samples")


def prior_signals(spark, sf):
    return market.prior(_candidates(spark, sf), R.as_of() - F.make_dt_interval(F.lit(_DAYS)))


def market_profile(spark, sf):
    return _profiles(spark, sf)


def _features(o):
    return o.filter("view_count IS NOT NULL").select(
        "external_id", F.col("category").alias("category_key"), F.lit(None).cast("string").alias("identity_key"), F.lit(0).alias("identity_confidence"), "price_eur", F.col("view_count").alias("views"),
        (F.col("ordinal") % 1400 + 20).cast("double").alias("age_minutes"), F.when(F.col("quantity") > 45, "").otherwise(F.col("family_key")).alias("cohort_key"),
    )


_SCORED = "category_ratio peer_median peer_p85 peer_ratio family_rate vs_history demand_growth demand_supply repeatability anomaly_ratio velocity_percentile price_delta_pct".split()


def opportunity_score(spark, sf):
    o = _offers(spark, sf)
    found = scoring.initial_scores(_features(o), _profiles(spark, sf, o))
    return found.select(
        "external_id", "category", "peer_count", "saturation", "trend_evidence", "score", "confidence", "stage", "opportunity_type", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in _SCORED], *[f"predicted_{h}h_{x}" for h in (3, 6) for x in ("low", "high")]
    )


def shortlist(spark, sf):
    # Scores from the relation itself, so that SQL can have them too.
    o = R.offers(spark, sf).filter("view_count IS NOT NULL")
    scores = o.select("external_id", "category", F.col("family_key").alias("cohort_key"), (F.col("price_eur") % 101).alias("score"), (F.col("quantity") / 50).alias("repeatability"), (F.col("view_count") / 350).alias("velocity_percentile"), F.when(F.col("l_linenumber") == 3, "saturated").otherwise("spark").alias("opportunity_type"))
    return scoring.shortlist(scores, total=40).select("external_id", "category", "cohort_key", "score", "is_control")


def _measured(spark, sf):
    o = R.offers(spark, sf).filter("view_count IS NOT NULL")
    return o.select(
        "external_id", (F.col("price_eur") % 101).alias("initial_score"), (F.col("quantity") / 4).alias("initial_vph"), F.col("quantity").alias("baseline_views"), (F.col("view_count") * 2).alias("views"),
        (F.col("l_linenumber") * 1.1).cast("double").alias("elapsed_hours"), F.lit(4.0).alias("peer_median"), (F.col("family_confidence") / 4).alias("peer_p85"), F.when(F.col("l_linenumber") > 3, 6).otherwise(3).alias("target_hours"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("view_count")).alias("previous_views"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(1.0)).alias("previous_elapsed"),
    )


def dynamic_score(spark, sf):
    return scoring.dynamic_score(_measured(spark, sf)).select("external_id", "gain", F.round("observed_vph", 6).alias("observed_vph"), F.round("recent_vph", 6).alias("recent_vph"), F.round("momentum", 6).alias("momentum"), "score", "stage", "outcome")


def reclassified(spark, sf):
    o = R.offers(spark, sf)
    c = F.col
    kind = scoring.reclassified(c("price_eur") % 101, c("quantity") * 2, c("l_linenumber") / 3, c("family_confidence") / 60, c("l_linenumber") / 4, F.when(c("l_linenumber") == 1, "emerging").otherwise("spark"))
    return o.select("external_id", kind.alias("opportunity_type"))


def forecast_accuracy(spark, sf):
    found = scoring.forecast_accuracy(_candidates(spark, sf).withColumnRenamed("current_score", "score"))
    return found.select("band", "resolved", "confirmed", F.round("hit_rate", 6).alias("hit_rate"))


def repeat_suppression(spark, sf):
    c = _candidates(spark, sf)
    selected = c.filter("current_score >= 90")
    tracked = c.filter("current_score < 10 AND NOT is_control").select((F.concat(F.split("external_id", ":")[0], F.lit(":1"))).alias("external_id"), "is_control")
    return scoring.without_recent(selected, tracked).select("external_id", "is_control", "current_score")


def _observations(spark, sf):
    o = R.offers(spark, sf)
    base = F.col("posted_at").cast("timestamp")
    rows = o.select("external_id", base.alias("baseline_at"), (F.col("l_linenumber") % 2).alias("attempts"), "l_linenumber")
    return observations.plan(rows.drop("attempts")).withColumn("attempts", F.col("l_linenumber") % 2)


def observation_triage(spark, sf):
    listings = R.offers(spark, sf).select("external_id", "view_count", (F.col("posted_at").cast("timestamp") + F.make_dt_interval(hours=F.col("quantity") % 7)).alias("views_checked_at"))
    found = observations.triage(_observations(spark, sf), listings, R.as_of("1998-01-01 02:00:00"))
    return found.select("external_id", "target_hours", "action")


def next_scan(spark, sf):
    scans = R.scans(spark, sf)
    return observations.next_scan(scans, scans.filter("scan_id % 2 = 0").select("scan_id")).select("scan_id", "category", "finished_at")


def stale_recovery(spark, sf):
    scans = R.scans(spark, sf).withColumn("started_at", F.col("finished_at"))
    return observations.recovered(scans, R.as_of()).groupBy("status", "recovered").count().withColumnRenamed("count", "n")


def monotone_measurements(spark, sf):
    v = R.views(spark, sf)
    current = R.offers(spark, sf).select("external_id", F.when(F.col("l_linenumber") < 3, F.col("posted_at") + F.expr("INTERVAL 4 HOURS")).alias("views_checked_at"))
    # Arrival in another order than measured: the second point comes first.
    measured = v.select("external_id", "view_count", F.col("recorded_at").alias("measured_at"), ((F.col("id") + 2) % 3).alias("seq"))
    return observations.accepted_measurements(current, measured).select("external_id", "seq", "view_count")


def latest_wins(spark, sf):
    rows = R.price_history(spark, sf)
    return observations.latest(rows, ["external_id"], "recorded_at", "id").select("external_id", "price_eur", "recorded_at")


def missing_users(spark, sf):
    users = R.table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"))
    return observations.missing_users(R.scans(spark, sf), users)


def mid_rank(spark, sf):
    found = stats.mid_rank(R.offers(spark, sf).select("external_id", "category", "price_eur"), "price_eur", ["category"], "pct")
    return found.select("external_id", "category", F.round("pct", 6).alias("pct"))


def percentiles(spark, sf):
    o = R.offers(spark, sf)
    return o.groupBy("category").agg(*[F.round(stats.percentile(F.col("price_eur").cast("double"), q), 6).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.85, 0.9)])


def ema_telemetry(spark, sf):
    e = R.table(spark, sf, "events").select("user_id", "event_id", "value")
    return stats.ema(e, ["user_id"], "event_id", "value", 0.25, "ema").select("user_id", F.round("ema", 6).alias("ema"))


def cohort_keys(spark, sf):
    o = R.offers(spark, sf)
    return o.select("external_id", text.cohort_key(F.when(F.col("l_linenumber") < 4, F.col("normal")), F.col("quantity") * 2, F.col("family_key")).alias("cohort_key"))


QUERIES = {f.__name__: f for f in (supply_profile, demand_profile, prior_signals, market_profile, opportunity_score, shortlist, dynamic_score, reclassified, forecast_accuracy, repeat_suppression, observation_triage, next_scan, stale_recovery, monotone_measurements, latest_wins, missing_users, mid_rank, percentiles, ema_telemetry, cohort_keys)}

_T = f"TIMESTAMP '{R.AS_OF}'"
_CAND = "cand AS (SELECT external_id, category, family_key, posted_at AS created_at, is_promoted AS is_control, price_eur % 100 AS score, CASE price_eur % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'pending' END AS outcome FROM offers)"
_SUPPLY = f"""fam AS (SELECT category, family_key, count(*) AS n, quantile_cont(CAST(price_eur AS DOUBLE), 0.5) FILTER (WHERE price_eur > 0) AS median,
    count(*) FILTER (WHERE posted_at >= {_T} - INTERVAL {_WINDOW} DAY) AS recent, count(*) FILTER (WHERE posted_at < {_T} - INTERVAL {_WINDOW} DAY AND posted_at >= {_T} - INTERVAL {2 * _WINDOW} DAY) AS previous
    FROM offers WHERE posted_at >= {_T} - INTERVAL {_DAYS} DAY AND NOT is_promoted GROUP BY 1, 2),
  sup AS (SELECT category, family_key, n, median, recent, previous, CASE WHEN count(*) OVER c <= 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY category ORDER BY n) - 1 + 0.5 * count(*) OVER (PARTITION BY category, n)) / count(*) OVER c END AS supply_percentile,
    least(4.0, greatest(0.25, ((recent + 1) / (previous + 1)) / greatest(0.25, (sum(recent) OVER c + 2) / (sum(previous) OVER c + 2)))) AS supply_growth_ratio FROM fam WINDOW c AS (PARTITION BY category))"""


def _demand(name: str, start: int, end: int | None) -> str:
    known = f"AND o.posted_at < {_T} - INTERVAL {end} DAY" if end else ""
    seen = f"AND recorded_at < {_T} - INTERVAL {end} DAY + INTERVAL 2 DAY" if end else ""
    return f"""{name} AS (SELECT family_key, quantile_cont(rate, 0.5) AS rate, count(*) AS samples FROM (
    SELECT o.family_key, (v.lv - v.fv) / ((epoch_us(v.la) - epoch_us(v.fa)) / 3.6e9) AS rate FROM (
      SELECT external_id, arg_min(view_count, recorded_at) AS fv, arg_max(view_count, recorded_at) AS lv, min(recorded_at) AS fa, max(recorded_at) AS la, count(*) AS n
      FROM views WHERE recorded_at >= {_T} - INTERVAL {start} DAY {seen} GROUP BY 1) v JOIN offers o USING (external_id)
    WHERE v.n >= 2 AND epoch_us(v.la) - epoch_us(v.fa) >= 1.8e9 AND v.lv >= v.fv AND o.posted_at >= {_T} - INTERVAL {start} DAY {known} AND NOT o.is_promoted) GROUP BY 1)"""


_PRIOR = f"pri AS (SELECT family_key, count(*) FILTER (WHERE score >= 65) AS prior_signals, count(*) FILTER (WHERE outcome = 'confirmed') AS prior_confirmed FROM cand WHERE created_at >= {_T} - INTERVAL {_DAYS} DAY AND NOT is_control GROUP BY 1)"

SQL = {
    "supply_profile": f"WITH {R.OFFERS}, {_SUPPLY} SELECT category, family_key, n, median, recent, previous, round(supply_percentile, 6) AS supply_percentile, round(supply_growth_ratio, 6) AS supply_growth_ratio FROM sup",
    "demand_profile": f"WITH {R.OFFERS}, {R.VIEWS}, {_demand('d', 2 * _WINDOW, _WINDOW)} SELECT family_key, round(rate, 6) AS rate, samples FROM d",
    "prior_signals": f"WITH {R.OFFERS}, {_CAND}, {_PRIOR} SELECT * FROM pri",
    "market_profile": f"""WITH {R.OFFERS}, {R.VIEWS}, {_CAND}, {_SUPPLY}, {_demand("rd", _WINDOW, None)}, {_demand("pd", 2 * _WINDOW, _WINDOW)}, {_PRIOR},
      k AS (SELECT family_key, max(category) AS category FROM offers GROUP BY 1), tot AS (SELECT family_key, CAST(sum(n) AS BIGINT) AS n, CAST(sum(recent) AS BIGINT) AS recent, CAST(sum(previous) AS BIGINT) AS previous FROM sup GROUP BY 1)
      SELECT k.category, k.family_key, sup.median, coalesce(tot.n, 0) AS count, coalesce(sup.supply_percentile, 0) AS supply_percentile, coalesce(tot.recent, 0) AS recent_count, coalesce(tot.previous, 0) AS previous_count,
        coalesce(sup.supply_growth_ratio, 1) AS supply_growth_ratio, rd.rate AS demand_recent_median, pd.rate AS demand_previous_median,
        coalesce(CASE WHEN pd.rate > 0 AND rd.rate IS NOT NULL THEN least(4.0, greatest(0.25, rd.rate / pd.rate)) END, 1) AS demand_growth_ratio,
        coalesce(rd.samples, 0) AS demand_recent_samples, coalesce(pd.samples, 0) AS demand_previous_samples, coalesce(prior_signals, 0) AS prior_signals, coalesce(prior_confirmed, 0) AS prior_confirmed
      FROM k LEFT JOIN sup ON sup.family_key = k.family_key AND sup.category = k.category LEFT JOIN tot ON tot.family_key = k.family_key LEFT JOIN rd ON rd.family_key = k.family_key
        LEFT JOIN pd ON pd.family_key = k.family_key LEFT JOIN pri ON pri.family_key = k.family_key""",
    "shortlist": f"""WITH {R.OFFERS}, s AS (SELECT external_id, category, family_key AS cohort_key, price_eur % 101 AS score, quantity / 50 AS rep, view_count / 350 AS vel, l_linenumber FROM offers WHERE view_count IS NOT NULL),
      a AS (SELECT * FROM s WHERE score >= 65 AND NOT (l_linenumber = 3 AND score < 90) QUALIFY row_number() OVER (PARTITION BY category, cohort_key ORDER BY score DESC, rep DESC, vel DESC, external_id) <= 2),
      b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, rep DESC, vel DESC, external_id) AS r FROM a QUALIFY r <= 10),
      low AS (SELECT * FROM s WHERE score < 65 QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, rep DESC, vel DESC, external_id) <= 2)
      SELECT external_id, category, cohort_key, score, false AS is_control FROM (SELECT * FROM b ORDER BY score DESC, category, r LIMIT 40) UNION ALL SELECT external_id, category, cohort_key, score, true FROM low""",
    "dynamic_score": f"""WITH {R.OFFERS}, m AS (SELECT external_id, price_eur % 101 AS i, quantity / 4 AS vph, greatest(0, view_count * 2 - quantity) AS gain, view_count * 2 AS views, greatest(0.25, CAST(l_linenumber * 1.1 AS DOUBLE)) AS el,
        family_confidence / 4 AS p85, CASE WHEN l_linenumber > 3 THEN 6 ELSE 3 END AS th, CASE WHEN l_linenumber % 2 = 0 THEN view_count END AS pv FROM offers WHERE view_count IS NOT NULL),
      o AS (SELECT *, gain / el AS obs, CASE WHEN pv IS NOT NULL THEN greatest(0, views - pv) / greatest(0.10, el - 1.0) ELSE gain / el END AS rec FROM m),
      s AS (SELECT *, least(1, greatest(0, (obs - 4.0) / greatest(1.0, p85 - 4.0))) AS st, CASE WHEN vph <= 0 THEN CASE WHEN rec > 0 THEN 1.0 ELSE 0.0 END ELSE rec / greatest(0.5, vph) END AS mom FROM o),
      c AS (SELECT *, CAST(round_even(least(100.0, greatest(0.0, i * 0.45 + st * 37.0 + least(1, greatest(0, mom - 0.5)) * 18.0)), 0) AS INTEGER) AS score FROM s)
      SELECT external_id, gain, round(obs, 6) AS observed_vph, round(rec, 6) AS recent_vph, round(mom, 6) AS momentum, score, CASE WHEN score >= 90 THEN 'early_winner' WHEN score >= 80 THEN 'rising' ELSE 'watch' END AS stage,
        CASE WHEN th >= 3 AND gain >= 10 AND obs >= greatest(2.0, p85) * 1.15 AND score >= 88 THEN 'confirmed' WHEN th >= 6 THEN CASE WHEN gain >= 10 AND obs >= greatest(2.0, p85) AND score >= 84 THEN 'confirmed' ELSE 'rejected' END ELSE 'pending' END AS outcome FROM c""",
    "reclassified": f"""WITH {R.OFFERS}, x AS (SELECT external_id, price_eur % 101 AS s, quantity * 2 AS sat, l_linenumber / 3 AS mom, family_confidence / 60 AS rep, l_linenumber / 4 AS ds, l_linenumber = 1 AS em FROM offers)
      SELECT external_id, CASE WHEN s >= 82 AND sat >= 65 AND mom >= 1.15 THEN 'hot_product' WHEN s >= 84 AND sat <= 45 AND rep >= 0.42 THEN 'hidden_gem' WHEN s >= 82 AND ds >= 1.12 AND mom >= 1.08 THEN 'emerging'
        WHEN sat >= 70 AND mom < 1.05 THEN 'saturated' WHEN em THEN 'emerging' ELSE 'spark' END AS opportunity_type FROM x""",
    "forecast_accuracy": f"""WITH {R.OFFERS}, {_CAND} SELECT CAST(score // 10 * 10 AS INTEGER) AS band, count(*) AS resolved, count(*) FILTER (WHERE outcome = 'confirmed') AS confirmed,
      round(count(*) FILTER (WHERE outcome = 'confirmed') / count(*), 6) AS hit_rate FROM cand WHERE outcome <> 'pending' GROUP BY 1""",
    "repeat_suppression": f"""WITH {R.OFFERS}, {_CAND} SELECT external_id, is_control, score AS current_score FROM cand WHERE score >= 90 AND (is_control OR external_id NOT IN (
      SELECT string_split(external_id, ':')[1] || ':1' FROM cand WHERE score < 10 AND NOT is_control))""",
    "observation_triage": f"""WITH {R.OFFERS}, p AS (SELECT *, unnest([1, 3, 6]) AS th FROM offers), d AS (SELECT *, posted_at + to_hours(th) AS due, posted_at + to_hours(quantity % 7) AS checked FROM p)
      SELECT external_id, th AS target_hours, CASE WHEN TIMESTAMP '1998-01-01 02:00:00' - INTERVAL 90 MINUTE > due AND l_linenumber % 2 = 0 THEN 'missed'
        WHEN view_count IS NOT NULL AND checked >= due - INTERVAL 15 MINUTE AND checked > posted_at THEN 'reusable' ELSE 'remote' END AS action FROM d WHERE due <= TIMESTAMP '1998-01-01 02:00:00'""",
    "next_scan": f"WITH {R.SCANS} SELECT scan_id, category, finished_at FROM scans WHERE status = 'done' AND is_complete AND rows > 0 AND scan_id % 2 <> 0 ORDER BY finished_at, scan_id LIMIT 1",
    "stale_recovery": f"""WITH {R.SCANS}, x AS (SELECT status = 'running' AND finished_at < {_T} - INTERVAL 20 MINUTE AS recovered, status FROM scans)
      SELECT CASE WHEN recovered THEN 'pending' ELSE status END AS status, recovered, count(*) AS n FROM x GROUP BY 1, 2""",
    "monotone_measurements": f"""WITH {R.OFFERS}, {R.VIEWS}, m AS (SELECT v.external_id, (v.id + 2) % 3 AS seq, v.view_count, recorded_at, CASE WHEN o.l_linenumber < 3 THEN o.posted_at + INTERVAL 4 HOUR END AS known FROM views v JOIN offers o USING (external_id)),
      k AS (SELECT *, greatest(known, max(recorded_at) OVER (PARTITION BY external_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS before FROM m)
      SELECT external_id, CAST(seq AS BIGINT) AS seq, view_count FROM k WHERE before IS NULL OR recorded_at >= before""",
    "latest_wins": f"WITH {R.HISTORY} SELECT external_id, price_eur, recorded_at FROM history QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY recorded_at DESC) = 1",
    "missing_users": "SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)",
    "mid_rank": f"""WITH {R.OFFERS} SELECT external_id, category, round((rank() OVER (PARTITION BY category ORDER BY price_eur) - 1 + 0.5 * count(*) OVER (PARTITION BY category, price_eur)) / count(*) OVER (PARTITION BY category), 6) AS pct FROM offers""",
    "percentiles": f"WITH {R.OFFERS} SELECT category, {', '.join(f'round(quantile_cont(CAST(price_eur AS DOUBLE), {q}), 6) AS p{int(q * 100)}' for q in (0.25, 0.5, 0.85, 0.9))} FROM offers GROUP BY 1",
    "ema_telemetry": "SELECT user_id, round(list_reduce(list(CAST(value AS DOUBLE) ORDER BY event_id), lambda a, x: a * 0.75 + x * 0.25), 6) AS ema FROM events GROUP BY 1",
    "cohort_keys": f"WITH {R.OFFERS} SELECT external_id, CASE WHEN l_linenumber < 4 AND quantity * 2 >= 70 THEN 'id:' || normal ELSE family_key END AS cohort_key FROM offers",
}

_RATIO = "least(1.0, greatest(0.0, (log2(greatest(0.05, {0})) + 1) / 3))"
_GROWTH = "least(1.0, greatest(0.0, 0.5 + log2(least(5.0, greatest(0.2, CASE WHEN {0} <> 0 THEN {0} ELSE 1.0 END))) / 2))"
_LOG = "CASE WHEN {0} > 0 THEN ln(least(5.0, greatest(0.2, {0}))) END"
_AT = "CAST(round_even(views + vph * {h} * {k} * (1 {s} u), 0) AS INTEGER)"
_Q = "quantile_cont(vph, 0.5) AS {0}50, quantile_cont(vph, 0.85) AS {0}85, quantile_cont(vph, 0.9) AS {0}90"

SQL["opportunity_score"] = f"""WITH {R.OFFERS}, profile AS ({SQL["market_profile"]}),
  f AS (SELECT external_id, category, price_eur, view_count AS views, CAST(ordinal % 1400 + 20 AS DOUBLE) AS age, CASE WHEN quantity > 45 THEN '' ELSE family_key END AS ck, view_count / greatest(0.25, CAST(ordinal % 1400 + 20 AS DOUBLE) / 60) AS vph FROM offers WHERE view_count IS NOT NULL),
  mixed AS (SELECT category, quantile_cont(vph, 0.5) AS rate FROM f WHERE ck <> '' GROUP BY category, ck UNION ALL SELECT category, vph FROM f WHERE ck = ''),
  few AS (SELECT category FROM mixed GROUP BY 1 HAVING count(*) < 2),
  bal AS MATERIALIZED (SELECT * FROM mixed WHERE category NOT IN (SELECT category FROM few) UNION ALL SELECT category, vph FROM f WHERE category IN (SELECT category FROM few)),
  base AS (SELECT category, greatest(0.25, quantile_cont(rate, 0.5)) AS cm, greatest(greatest(0.25, quantile_cont(rate, 0.5)), quantile_cont(rate, 0.75)) AS p75 FROM bal GROUP BY 1),
  whole AS (SELECT category, count(*) AS size, {_Q.format("q")} FROM f GROUP BY 1),
  coh AS (SELECT f.category, ck, count(*) AS peers, count(*) FILTER (WHERE vph >= p75) AS strong, {_Q.format("c")} FROM f JOIN base USING (category) WHERE ck <> '' GROUP BY 1, 2),
  vr AS MATERIALIZED (SELECT v.category, v.vph, CASE WHEN count(*) <= 1 THEN 0.5 ELSE (count(*) FILTER (WHERE rate < v.vph) + 0.5 * count(*) FILTER (WHERE rate = v.vph)) / count(*) END AS velocity_percentile FROM (SELECT DISTINCT category, vph FROM f) v JOIN bal ON bal.category = v.category GROUP BY 1, 2),
  a AS (SELECT f.*, velocity_percentile, size, cm, coalesce(peers, 0) AS peers, coalesce(strong, 0) AS strong, q50, q85, q90, c50, c85, c90, p.median, coalesce(p.count, 0) AS mc, coalesce(supply_percentile, 0) AS sp, coalesce(supply_growth_ratio, 1) AS sg, demand_recent_median AS rm, demand_previous_median AS pm,
    coalesce(demand_recent_samples, 0) AS rs, coalesce(demand_previous_samples, 0) AS ps, coalesce(prior_signals, 0) AS signals, coalesce(prior_confirmed, 0) AS confirmed
    FROM f JOIN base USING (category) JOIN whole USING (category) JOIN vr ON vr.category = f.category AND vr.vph = f.vph LEFT JOIN coh ON coh.category = f.category AND coh.ck = f.ck LEFT JOIN profile p ON p.family_key = f.ck),
  b AS (SELECT *, CASE WHEN peers >= 3 THEN peers ELSE size END AS peer_count, CASE WHEN peers >= 3 THEN c50 ELSE q50 END AS peer_median, CASE WHEN peers >= 3 THEN c85 ELSE q85 END AS peer_p85, vph / cm AS category_ratio, CASE WHEN peers >= 2 THEN c50 ELSE vph END AS family_rate, rs + ps AS history,
    CASE WHEN mc <= 0 THEN 0 ELSE CAST(round_even(100 * least(1.0, greatest(0.0, 0.86 * least(1.0, greatest(0.0, sp)) + 0.14 * least(1.0, greatest(0.0, CASE WHEN ck <> '' THEN peers / size ELSE 0.0 END / 0.25)))), 0) AS INTEGER) END AS saturation,
    least(4.0, greatest(0.25, CASE WHEN sg <> 0 THEN sg ELSE 1.0 END)) AS supply, CASE WHEN peers > 0 THEN 0.65 * strong / peers + 0.35 * least(1.0, greatest(0.0, (peers - 1) / 4.0)) ELSE 0.28 END AS now FROM a),
  c AS (SELECT *, CASE WHEN peers >= 3 THEN vph / greatest(0.25, peer_median) ELSE category_ratio END AS peer_ratio, CASE WHEN rm > 0 AND rs >= 2 THEN family_rate / greatest(0.25, rm) END AS vs_history, CASE WHEN rm IS NOT NULL AND pm > 0 AND history >= 4 THEN rm / greatest(0.25, pm) END AS grown FROM b),
  d AS (SELECT *, {_LOG.format("vs_history")} AS l1, {_LOG.format("grown")} AS l2 FROM c),
  e AS (SELECT *, l1 IS NOT NULL OR l2 IS NOT NULL AS trend_evidence, CASE WHEN l1 IS NOT NULL OR l2 IS NOT NULL THEN least(5.0, greatest(0.2, exp((coalesce(l1, 0) + coalesce(l2, 0)) / (CAST(l1 IS NOT NULL AS INTEGER) + CAST(l2 IS NOT NULL AS INTEGER))))) ELSE 1.0 END AS demand_growth,
    least(1.0, greatest(0.0, CASE WHEN signals > 0 THEN 0.65 * now + 0.35 * confirmed / signals ELSE now END)) AS repeatability, greatest(category_ratio, coalesce(vs_history, 0.0)) AS anomaly_ratio, CASE WHEN median > 0 THEN (median - price_eur) / median END AS pd FROM d),
  g AS (SELECT *, CASE WHEN trend_evidence THEN least(4.0, greatest(0.25, demand_growth / greatest(0.5, supply))) ELSE 1.0 END AS demand_supply,
    CASE WHEN vs_history IS NOT NULL THEN 0.42 * {_RATIO.format("category_ratio")} + 0.18 * {_RATIO.format("peer_ratio")} + 0.40 * {_GROWTH.format("vs_history")} ELSE 0.72 * {_RATIO.format("category_ratio")} + 0.28 * {_RATIO.format("peer_ratio")} END AS anomaly FROM e),
  h AS (SELECT *, 34.0 * (0.68 * velocity_percentile + 0.32 * (0.72 * least(1.0, greatest(0.0, ln(1 + greatest(0.0, vph)) / ln(31.0))) + 0.28 * least(1.0, greatest(0.0, ln(1 + greatest(0.0, CAST(views AS DOUBLE))) / ln(121.0))))) + 26.0 * anomaly
      + 16.0 * CASE WHEN trend_evidence THEN {_GROWTH.format("demand_growth")} ELSE 0.5 END + 12.0 * CASE WHEN trend_evidence THEN {_GROWTH.format("demand_supply")} ELSE 0.5 END + 8.0 * repeatability + 3.0 * least(1.0, greatest(0.0, 1 - age / (24.0 * 60))) + 1.0 * CASE WHEN pd IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, 0.5 + 2.5 * pd)) END AS raw,
    34.0 + least(18.0, greatest(0, peers - 1) * 2.5) + least(18.0, sqrt(CASE WHEN mc > 0 THEN mc ELSE peers END) * 2.6) + least(14.0, history * 1.4) + least(8.0, signals * 1.2) + CASE WHEN ck <> '' THEN 3.0 ELSE 0.0 END AS evidence FROM g),
  i AS (SELECT *, CAST(round_even(least(100.0, greatest(0.0, raw)), 0) AS INTEGER) AS score, CAST(round_even(least(97.0, greatest(22.0, evidence)), 0) AS INTEGER) AS confidence, greatest(demand_growth, demand_supply) AS moves FROM h),
  j AS (SELECT *, least(0.38, greatest(0.16, 0.44 - 0.0027 * confidence)) AS u FROM i),
  k AS (SELECT *, greatest(views, {_AT.format(h=3, k=0.92, s="-")}) AS predicted_3h_low, greatest(views, {_AT.format(h=6, k=0.84, s="-")}) AS predicted_6h_low FROM j)
  SELECT external_id, category, CAST(peer_count AS INTEGER) AS peer_count, saturation, trend_evidence, score, confidence, CASE WHEN score >= 90 THEN 'early_winner' WHEN score >= 80 THEN 'rising' ELSE 'watch' END AS stage,
    CASE WHEN score >= 80 AND saturation >= 65 AND trend_evidence AND moves >= 1.18 THEN 'hot_product' WHEN score >= 80 AND saturation <= 45 AND anomaly_ratio >= 1.45 AND repeatability >= 0.42 THEN 'hidden_gem' WHEN score >= 80 AND trend_evidence AND demand_supply >= 1.12 AND moves >= 1.18 THEN 'emerging'
      WHEN saturation >= 70 AND (NOT trend_evidence OR moves < 1.12) THEN 'saturated' ELSE 'spark' END AS opportunity_type, {", ".join(f"round({'100 * pd' if c == 'price_delta_pct' else c} + 1e-9, 6) AS {c}" for c in _SCORED)},
    predicted_3h_low, greatest(predicted_3h_low, {_AT.format(h=3, k=0.92, s="+")}) AS predicted_3h_high, predicted_6h_low, greatest(predicted_6h_low, {_AT.format(h=6, k=0.84, s="+")}) AS predicted_6h_high FROM k"""
