"""Checkpoints, payloads, gates, touches, categories and queues over the derived relations (survey 2.1-2.10)."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import timeparse
from ..operators import admin, categories, checkpoints, chronology, filters, observations, touches
from ..shared import numbered
from ..streaming import measurements
from . import relations as R
from .operations import _ITEMS, _PROFILE, _TARGET, _USERS, _page_items, _users
from .operations import _T as _T

_AS_OF = R.AS_OF


def _c(name):
    return F.col(name)


def accepted_touches(spark, sf):
    e = R.table(spark, sf, "events").select((_c("user_id") % 40).alias("user_id"), _c("ts").cast("timestamp").alias("at"))
    return touches.accepted_touches(e, 600).select("user_id", _c("at").cast("timestamp_ntz").alias("at"))


def refined_boundary(spark, sf):
    profile = chronology.page_profile(_page_items(spark, sf), F.lit(_TARGET).cast("date"), ["feed", "page"]).select("feed", "page", "relation")
    cold = F.explode(F.array(*[F.lit(p) for p in chronology.cold_pages(9)])).alias("page")
    probes = spark.range(40).select(_c("id").alias("feed"), cold)
    return chronology.refined_boundary(profile, probes, ["feed"])


def _checkpoints(spark, sf):
    """Orders as checkpoints of pages."""
    o = R.table(spark, sf, "orders")
    status = F.when(_c("o_orderstatus") == "F", "verified").when(_c("o_orderstatus") == "O", "failed").otherwise("partial")
    return o.select(_c("o_orderkey").alias("page_key"), status.alias("status"), (_c("o_orderkey") % 3).cast("int").alias("attempts"), F.when(_c("o_orderkey") % 4 == 0, "old").alias("error_text"), F.date_add(_c("o_orderdate"), 0).cast("timestamp").alias("checked_at"))


_PAGES = "pages AS (SELECT o_orderkey AS page_key, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'failed' ELSE 'partial' END AS status, CAST(o_orderkey % 3 AS INTEGER) AS attempts, CASE WHEN o_orderkey % 4 = 0 THEN 'old' END AS error_text, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS checked_at FROM orders)"
_NOW = "TIMESTAMP '1995-06-01 00:00:00'"


def live_checkpoints(spark, sf):
    now = F.lit("1995-06-01 00:00:00").cast("timestamp")
    return checkpoints.live(_checkpoints(spark, sf), "checked_at", now, 90 * 86_400).select("page_key", "attempts")


def cleaned_up(spark, sf):
    now = F.lit("1995-06-01 00:00:00").cast("timestamp")
    rows = _checkpoints(spark, sf)
    jobs = rows.withColumn("status", F.when(_c("status") == "verified", "done").otherwise("running"))
    left, gone = checkpoints.cleaned({"pages": (rows, "checked_at"), "indexes": (rows.filter("page_key % 2 = 0"), "checked_at"), "jobs": (jobs, "checked_at")}, now, hours=24 * 30)
    return gone.join(left["jobs"].agg(F.count(F.lit(1)).alias("jobs_left")), F.lit(True))


def failed_checkpoints(spark, sf):
    lines = R.table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    failures = lines.select(F.when(_c("l_linenumber") == 2, -_c("l_orderkey")).otherwise(_c("l_orderkey")).alias("page_key"), F.concat(F.lit("line "), _c("l_linenumber"), F.repeat(F.lit("x"), 600)).alias("error_text"), (_c("l_shipdate") + F.make_dt_interval(mins=_c("l_linenumber"))).alias("at"))
    found = checkpoints.with_failures(_checkpoints(spark, sf), failures.select("page_key", "error_text", _c("at").cast("timestamp").alias("at")), ["page_key"])
    return found.select("page_key", "status", "attempts", F.substring("error_text", 1, 8).alias("error_text"), F.length("error_text").alias("n"), _c("checked_at").cast("timestamp_ntz").alias("checked_at"))


def marked_notices(spark, sf):
    u = _users(spark, sf)
    # Every third mark has seen another end than there is now.
    seen = F.when(_c("user_id") % 3 == 0, _c("access_until") + F.expr("INTERVAL 1 HOUR")).otherwise(_c("access_until"))
    marks = u.filter("user_id % 5 <> 0").select("user_id", seen.alias("access_until"), F.when(_c("user_id") % 2 == 0, "warning").otherwise("expired").alias("kind"))
    ntz = lambda c: _c(c).cast("timestamp_ntz").alias(c)
    return checkpoints.marked(u, marks).select("user_id", ntz("expiring_sent_for"), ntz("expired_sent_for"))


def job_leftovers(spark, sf):
    lines = R.table(spark, sf, "lineitem").select(_c("l_orderkey").cast("string").alias("job_id"), (_c("l_partkey") % 50).cast("string").alias("url"), "l_returnflag")
    return checkpoints.left_over(lines, lines.filter("l_returnflag = 'R'"))


def _page_payloads(spark, sf):
    """An order as a page: its lines are the items; some lack an address or have a price in digits, some payloads are cut or no object."""
    o = R.offers(spark, sf)
    item = F.struct(
        _c("external_id"), _c("title"), F.lit(None).cast("string").alias("price_text"), _c("price_eur").cast("string").alias("price_eur"), F.when(_c("l_linenumber") != 3, F.concat(F.lit("u/"), "external_id")).alias("url"), F.lit("Heute").alias("posted_text"),
    )
    pages = o.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    info = F.struct(
        (_c("l_orderkey") % 4).alias("requested_page"), F.lit("f").alias("final_url"), "items", F.when(_c("l_orderkey") % 6 == 0, _c("l_orderkey")).alias("total_results"), (_c("l_orderkey") % 2 == 0).alias("page_verified"), F.lit(0.5).alias("date_coverage"), F.array(F.lit("a"), F.lit("")).alias("promoted_ids"),
        F.array(F.array(F.lit("s"), F.lit("7")), F.array(F.lit(""), F.lit("1"))).alias("location_shards"),
    )
    raw = checkpoints.encoded(info)
    return pages.select("l_orderkey", F.when(_c("l_orderkey") % 11 == 0, F.substring(raw, 1, 20)).when(_c("l_orderkey") % 13 == 0, "[1]").when(_c("l_orderkey") % 17 == 0, F.replace(raw, F.lit('"price_eur":"'), F.lit('"price_eur":"~'))).otherwise(raw).alias("raw"))


def decoded_pages(spark, sf):
    p = _page_payloads(spark, sf).select("l_orderkey", checkpoints.decoded_page(_c("raw")).alias("p"))
    total = F.aggregate("p.items", F.lit(0).cast("long"), lambda a, i: a + i["price_eur"])
    return p.select(
        "l_orderkey", _c("p").isNotNull().alias("ok"), _c("p.requested_page").alias("requested_page"), F.size("p.items").alias("items"), total.alias("total"), _c("p.total_results").alias("total_results"), _c("p.page_verified").alias("verified"), _c("p.request_matches_page").alias("matches"),
        _c("p.location_shards")[0]["count"].alias("shard_count"), F.size("p.location_shards").alias("shards"), F.size("p.promoted_ids").alias("promoted"),
    )


def decoded_probes(spark, sf):
    e = R.table(spark, sf, "events").select("event_id", (_c("event_id") % 60).alias("page"), "event_type")
    relation = F.get(F.array(*map(F.lit, ("target", "newer", "older", "sideways", "empty"))), (_c("event_id") % 5).cast("int"))
    raw = F.to_json(F.struct("page", relation.alias("relation"), F.when(_c("event_id") % 2 == 0, "2024-01-01").alias("target_date"), (_c("event_id") % 4).cast("string").alias("target_count")))
    d = e.select("event_id", checkpoints.decoded_probe(raw).alias("probe"), checkpoints.decoded_predictor(raw).alias("predictor"))
    return d.select("event_id", _c("probe.relation").alias("relation"), _c("probe.page").alias("page"), _c("probe.target_count").alias("target_count"), _c("probe.source").alias("source"), _c("predictor.page").alias("predicted"))


def encoded_results(spark, sf):
    o = R.offers(spark, sf)
    result = F.struct(_c("view_count").alias("views"), F.repeat(F.lit("r"), _c("quantity") * 20).alias("raw_text"), F.when(_c("l_linenumber") > 2, "html").otherwise("").alias("source"), F.lit("https://x").alias("final_url"), F.repeat(F.lit("t"), _c("quantity") * 10).alias("page_title"), F.lit(None).cast("string").alias("error"))
    return o.select("external_id", checkpoints.encoded_result(result).alias("result"))


def page_gates(spark, sf):
    profile = chronology.page_profile(_page_items(spark, sf), F.lit(_TARGET).cast("date"), ["feed", "page"])
    sound = checkpoints.structural(F.when(_c("page") % 7 != 0, _c("page") % 5 != 0), _c("feed") % 9 != 0, F.when(_c("feed") % 2 == 0, _c("page") == 3))
    verdict = checkpoints.probe_verdict(sound, _c("relation"), _c("items"), _c("dated"), _c("confidence"), _c("target_count"), _c("page") % 4 != 0)
    trusted = filters.page_trusted(_c("feed") % 9 != 0, _c("page") % 5 != 0, _c("page") == 3, _c("items"), _c("dated"), _c("coverage"))
    return profile.select("feed", "page", verdict["safe"].alias("safe"), verdict["reason"].alias("reason"), trusted.alias("trusted"))


def queue_positions(spark, sf):
    queued = R.scans(spark, sf).filter("status = 'queued'").select("scan_id", "finished_at")
    return numbered(queued, [_c("finished_at"), _c("scan_id")], "position").select("scan_id", "position")


def active_scans(spark, sf):
    s = R.scans(spark, sf)
    return s.agg(F.count_if(_c("status").isin("queued", "running", "cancelling") & (_c("finished_at") > F.lit(_AS_OF).cast("timestamp"))).alias("active"), F.count(F.lit(1)).alias("scans"))


def running_counters(spark, sf):
    paid = R.scans(spark, sf).filter("status = 'done'")
    return paid.groupBy("user_id").agg(F.count(F.lit(1)).alias("payments_count"), F.round(F.sum("amount"), 2).alias("paid_total"))


def shadow_starts(spark, sf):
    c = R.table(spark, sf, "customer")
    setting = F.when(_c("c_custkey") % 3 == 0, F.concat(F.lit("1997-05-"), F.lpad((_c("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00"))).when(_c("c_custkey") % 3 == 1, "no date")
    return c.select("c_custkey", observations.shadow_start(setting, F.lit(_AS_OF).cast("timestamp"), 360).cast("timestamp_ntz").alias("start"))


def due_observations(spark, sf):
    o = R.offers(spark, sf)
    at = F.lit(_AS_OF).cast("timestamp")
    candidates = o.filter("l_linenumber <= 2").select(_c("ordinal").alias("candidate_id"), "external_id", _c("posted_at").cast("timestamp").alias("baseline_at"))
    planned = observations.plan(candidates).select(_c("candidate_id"), "target_hours", "due_at", "status", "attempts")
    listings = o.filter("l_linenumber <> 2").select("external_id", "view_count", _c("posted_at").cast("timestamp").alias("views_checked_at"))
    return observations.due(planned, candidates, listings, at, 50).select("candidate_id", "target_hours", _c("due_at").cast("timestamp_ntz").alias("due_at"), "view_count")


def network_candidates(spark, sf):
    o = R.offers(spark, sf)
    url = F.concat(F.lit("https://h/"), F.when(_c("l_linenumber") == 1, "s-vac-inc-get.json?id=").when(_c("l_linenumber") == 2, "api/Views/").when(_c("l_linenumber") == 6, "api/Views/").otherwise("static/"), (_c("quantity") % 4).cast("string"))
    body = F.concat(F.when(_c("l_linenumber") % 2 == 1, '{"counter":').otherwise('{"n":'), _c("view_count").cast("string"), F.lit("}"))
    seen = o.filter("view_count IS NOT NULL").select(_c("l_orderkey").alias("page"), url.alias("url"), body.alias("body"), F.when(_c("l_linenumber") == 1, _c("view_count")).alias("passive_views"), F.lit(12).alias("views"), "ordinal")
    return observations.network_candidates(seen, ["page"], "ordinal").select("page", "url", "score", "place")


def outbox_events(spark, sf):
    o = R.offers(spark, sf)
    outcome = lambda k: F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "rejected").otherwise("pending")
    stage = lambda k: F.when(k % 4 == 0, "early_winner").otherwise("watch")
    before = o.filter("l_linenumber <> 4").select(_c("ordinal").alias("candidate_id"), outcome(_c("price_eur")).alias("outcome"), stage(_c("price_eur")).alias("stage"))
    after = o.select(_c("ordinal").alias("candidate_id"), outcome(_c("quantity")).alias("outcome"), stage(_c("quantity")).alias("stage"))
    return observations.outbox(before, after).select("candidate_id", "event")


def counters_never_fall(spark, sf):
    e = R.table(spark, sf, "events")
    return observations.monotone_counters(e.select("user_id", (_c("event_id") % 97).alias("pages"), (_c("event_id") % 89).alias("items")), ["user_id"], ["pages", "items"])


def requested_views(spark, sf):
    lines = R.table(spark, sf, "lineitem")
    asked = lines.select(_c("l_orderkey").alias("job"), _c("l_linenumber").alias("ordinal"), _c("l_partkey").alias("url")).distinct()
    found = R.table(spark, sf, "part").filter("p_size % 3 <> 0").select(_c("p_partkey").alias("url"), _c("p_size").alias("views"))
    return observations.in_order(asked, found, "url").select("job", "ordinal", "url", "views")


def payment_states(spark, sf):
    o = R.table(spark, sf, "orders")
    remote = F.get(F.array(*map(F.lit, ("paid", "mismatch", "expired", "active"))), (_c("o_orderkey") % 4).cast("int"))
    status = F.when(_c("o_orderstatus") == "F", "pending").otherwise("paid")
    return o.select("o_orderkey", admin.payment_state(status, remote, _c("o_orderdate").cast("timestamp"), F.lit("1995-01-01 00:00:00").cast("timestamp")).alias("state"), admin.valid_price(_c("o_totalprice") - 1000).alias("price"))


def fresh_offers(spark, sf):
    o = R.offers(spark, sf).select("external_id", _c("view_count").alias("views"), (_c("ordinal") % 3000).cast("double").alias("age_minutes"))
    return filters.fresh(o).select("external_id")


def time_values(spark, sf):
    """A summer night on which Berlin's and Moscow's day has begun and UTC's hasn't."""
    now = F.lit("2024-07-10 22:30:00").cast("timestamp")
    e = R.table(spark, sf, "events").select("event_id", _c("ts").cast("timestamp").alias("at"))
    said = F.when(_c("event_id") % 2 == 0, F.concat(F.lit("heute , "), F.date_format("at", "H:mm"))).otherwise("Gestern, 10:00")
    seen = F.when(_c("event_id") % 7 != 0, _c("at"))
    late = measurements.is_missed(_c("at"), _c("at") + F.make_dt_interval(mins=_c("event_id") % 180))
    young = _c("at") >= timeparse.cutoff("6h", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    ntz = timeparse.sort_moment(said, seen, now).cast("timestamp_ntz")
    return e.filter("at IS NOT NULL").select("event_id", ntz.alias("moment"), timeparse.age_days(F.to_date("at"), now).alias("age_days"), late.alias("missed"), young.alias("young"))


def category_counts(spark, sf):
    closed = categories.closure(_dimension(spark, sf))
    top = categories.roots(closed).withColumnRenamed("key", "category")
    listings = R.offers(spark, sf).select(F.concat_ws("/", "category", F.split("title", " ")[2], F.split("title", " ")[0]).alias("category"))
    return categories.counts(listings, closed).join(F.broadcast(top), "category").select("category", "root", "listings")


def _dimension(spark, sf):
    """Kinds, brands and sorts of parts as a hierarchy: some hundreds of categories at any size."""
    path = R.table(spark, sf, "part").select(F.array("p_type", "p_brand", F.split("p_name", " ")[0]).alias("w")).distinct()
    up = lambda n: F.array_join(F.slice("w", 1, n), "/")
    level = F.explode(F.array(F.struct(up(1).alias("key"), F.lit(None).cast("string").alias("parent")), F.struct(up(2).alias("key"), up(1).alias("parent")), F.struct(up(3).alias("key"), up(2).alias("parent"))))
    return path.select(level.alias("c")).select("c.*").distinct()


def chosen_categories(spark, sf):
    c = R.table(spark, sf, "customer")
    k = _c("c_custkey")
    child = lambda n: F.concat(F.lit("c"), (n % 4).cast("string"))
    chosen = F.array_distinct(F.when(k % 5 == 0, F.array(F.lit("root"))).when(k % 5 == 1, F.array(child(k), F.lit("other"))).when(k % 5 == 2, F.array(F.lit("other"), F.lit("more"))).otherwise(F.array(child(k))))
    children = F.array(*[F.lit(f"c{i}") for i in range(4)])
    key = F.when(k % 7 == 0, "root").otherwise(child(F.floor(k / 5)))
    rows = c.select(k.alias("c_custkey"), chosen.alias("chosen"), key.alias("key"))
    t = categories.toggled(_c("chosen"), _c("key"), _c("key") == "root", F.lit("root"), children)
    f = categories.filled_up(_c("chosen"), F.lit("root"), children)
    v = categories.valid_choice(F.concat("chosen", F.array("key"), "chosen"), F.concat(children, F.array(F.lit("root"))))
    done = rows.select("c_custkey", t.alias("t"), f.alias("f"), v.alias("v"))
    return done.select("c_custkey", F.array_join("t.chosen", ",").alias("toggled"), _c("t.refused").alias("refused"), F.array_join("f.chosen", ",").alias("filled"), _c("f.short").alias("short"), F.array_join("v.keys", ",").alias("valid"), _c("v.error").alias("error"))


QUERIES = {
    f.__name__: f
    for f in (
        accepted_touches, refined_boundary, live_checkpoints, cleaned_up, failed_checkpoints, marked_notices, job_leftovers, decoded_pages, decoded_probes, encoded_results, page_gates, queue_positions, active_scans, running_counters, shadow_starts,
        due_observations, network_candidates, outbox_events, counters_never_fall, requested_views, payment_states, fresh_offers, time_values, category_counts, chosen_categories,
    )
}

_COLD = ", ".join(map(str, chronology.cold_pages(9)))


def _bound(seen: str, name: str) -> str:
    """The boundary by the pages of a CTE."""
    return f"""{name}a AS (SELECT feed, min(page) FILTER (WHERE relation = 'target') AS t, max(page) FILTER (WHERE relation = 'newer') AS ln, coalesce(bool_or(page = 1 AND relation IN ('older', 'mixed', 'empty')), false) AS once, count(*) FILTER (WHERE relation IN ('older', 'mixed', 'empty')) AS nn, count(*) AS probed FROM {seen} GROUP BY 1),
      {name}b AS (SELECT a.*, (SELECT max(page) FROM {seen} p WHERE p.feed = a.feed AND relation = 'newer' AND page < a.t) AS bt, (SELECT min(page) FROM {seen} p WHERE p.feed = a.feed AND relation IN ('target', 'older', 'mixed', 'empty') AND page > a.ln) AS ab FROM {name}a a),
      {name} AS (SELECT feed, CASE WHEN t IS NOT NULL THEN coalesce(bt, 0) WHEN once THEN 0 WHEN ab IS NOT NULL THEN ln END AS low, CASE WHEN t IS NOT NULL THEN t WHEN once THEN 1 ELSE ab END AS high,
        CASE WHEN t IS NOT NULL THEN 'done' WHEN ln IS NOT NULL AND nn = 0 THEN 'right' WHEN ln IS NULL AND nn > 0 THEN 'left' ELSE 'both' END AS direction, probed FROM {name}b)"""


def _narrowed(seen: str, bound: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM {seen} UNION SELECT p.feed, p.page, p.relation FROM prof0 p JOIN (SELECT feed, unnest([greatest(low + 1, least(high - 1, low + CAST(round_even((high - low) * r, 0) AS INTEGER))) for r in [0.25, 0.5, 0.75]]) AS page
      FROM {bound} WHERE high - low > 3) q ON q.feed = p.feed AND q.page = p.page)"""


_MOD = "CASE {0} % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'pending' END"
_STAGE = "CASE WHEN {0} % 4 = 0 THEN 'early_winner' ELSE 'watch' END"

SQL = {
    "accepted_touches": """WITH RECURSIVE t AS (SELECT user_id, moment, row_number() OVER (PARTITION BY user_id ORDER BY moment) AS n FROM (SELECT DISTINCT user_id % 40 AS user_id, ts AS moment FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)),
      f AS (SELECT user_id, n, moment AS last, moment FROM t WHERE n = 1 UNION ALL SELECT t.user_id, t.n, CASE WHEN t.moment >= f.last + INTERVAL 600 SECOND THEN t.moment ELSE f.last END, t.moment FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1)
      SELECT user_id, moment AS "at" FROM f WHERE last = moment""",
    "refined_boundary": f"""WITH {R.OFFERS}, {_ITEMS}, {_PROFILE}, prof0 AS (SELECT feed, page, relation FROM prof), s0 AS (SELECT * FROM prof0 WHERE page IN ({_COLD})), {_bound("s0", "b0")}, {_narrowed("s0", "b0", "s1")}, {_bound("s1", "b1")}, {_narrowed("s1", "b1", "s2")}, {_bound("s2", "b2")}
      SELECT * FROM b2""",
    "live_checkpoints": f"WITH {_PAGES} SELECT page_key, attempts FROM pages WHERE status = 'verified' AND checked_at >= {_NOW} - INTERVAL 90 DAY",
    "cleaned_up": f"""WITH {_PAGES}, x AS (SELECT *, checked_at < {_NOW} - INTERVAL 30 DAY AS old, checked_at < {_NOW} - INTERVAL 7 DAY AND status = 'verified' AS over FROM pages)
      SELECT count(*) FILTER (old) AS pages, count(*) FILTER (old AND page_key % 2 = 0) AS indexes, count(*) FILTER (over) AS jobs, count(*) FILTER (NOT over) AS jobs_left FROM x""",
    "failed_checkpoints": f"""WITH {_PAGES}, f AS (SELECT CASE WHEN l_linenumber = 2 THEN -l_orderkey ELSE l_orderkey END AS page_key, 'line ' || l_linenumber || repeat('x', 600) AS e, l_shipdate + to_minutes(l_linenumber) AS moment FROM lineitem WHERE l_returnflag = 'R'),
      g AS (SELECT page_key, CAST(count(*) AS INTEGER) AS n, substr(arg_max(e, moment), 1, 500) AS e, max(moment) AS moment FROM f GROUP BY 1)
      SELECT coalesce(p.page_key, g.page_key) AS page_key, CASE WHEN n IS NOT NULL THEN 'failed' ELSE status END AS status, coalesce(attempts, 0) + coalesce(n, 0) AS attempts, substr(CASE WHEN n IS NOT NULL THEN e ELSE error_text END, 1, 8) AS error_text,
        CAST(length(CASE WHEN n IS NOT NULL THEN e ELSE error_text END) AS INTEGER) AS n, coalesce(moment, checked_at) AS checked_at FROM pages p FULL JOIN g ON p.page_key = g.page_key""",
    "marked_notices": f"""WITH {_USERS} SELECT user_id, CASE WHEN user_id % 5 <> 0 AND (user_id % 3 <> 0 OR access_until IS NULL) AND user_id % 2 = 0 THEN access_until ELSE expiring_sent_for END AS expiring_sent_for,
        CASE WHEN user_id % 5 <> 0 AND (user_id % 3 <> 0 OR access_until IS NULL) AND user_id % 2 = 1 THEN access_until END AS expired_sent_for FROM users""",
    "job_leftovers": "WITH x AS (SELECT CAST(l_orderkey AS VARCHAR) AS job_id, CAST(l_partkey % 50 AS VARCHAR) AS url, l_returnflag AS f FROM lineitem) SELECT DISTINCT job_id, url FROM x EXCEPT SELECT job_id, url FROM x WHERE f = 'R'",
    "decoded_pages": f"""WITH {R.OFFERS}, p AS (SELECT l_orderkey, count(*) FILTER (l_linenumber <> 3) AS n, sum(price_eur) FILTER (l_linenumber <> 3) AS total, l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 AND NOT (l_orderkey % 17 = 0 AND bool_or(l_linenumber <> 3)) AS ok FROM offers GROUP BY 1)
      SELECT l_orderkey, ok, CASE WHEN ok THEN CAST(greatest(1, l_orderkey % 4) AS INTEGER) END AS requested_page, CASE WHEN ok THEN CAST(n AS INTEGER) END AS items, CASE WHEN ok THEN CAST(coalesce(total, 0) AS BIGINT) END AS total,
        CASE WHEN ok AND l_orderkey % 6 = 0 THEN CAST(l_orderkey AS INTEGER) END AS total_results, CASE WHEN ok THEN l_orderkey % 2 = 0 END AS verified, CASE WHEN ok THEN true END AS matches, CASE WHEN ok THEN CAST(7 AS BIGINT) END AS shard_count, CASE WHEN ok THEN 1 END AS shards, CASE WHEN ok THEN 1 END AS promoted FROM p""",
    "decoded_probes": """WITH x AS (SELECT event_id, event_id % 60 AS page, ['target', 'newer', 'older', 'sideways', 'empty'][event_id % 5 + 1] AS r FROM events)
      SELECT event_id, CASE WHEN r <> 'sideways' THEN r END AS relation, CASE WHEN r <> 'sideways' THEN CAST(greatest(1, page) AS INTEGER) END AS page, CASE WHEN r <> 'sideways' THEN CAST(event_id % 4 AS INTEGER) END AS target_count, CASE WHEN r <> 'sideways' THEN 'remote' END AS source,
        CASE WHEN event_id % 2 = 0 AND page BETWEEN 1 AND 50 THEN CAST(page AS INTEGER) END AS predicted FROM x""",
    "encoded_results": f"""WITH {R.OFFERS} SELECT external_id, '{{"views":' || coalesce(CAST(view_count AS VARCHAR), 'null') || ',"raw_text":"' || repeat('r', least(400, quantity * 20)) || '","source":"' || CASE WHEN l_linenumber > 2 THEN 'html' ELSE 'remote:unknown' END
      || '","final_url":"https://x","page_title":"' || repeat('t', least(200, quantity * 10)) || '","error":null}}' AS result FROM offers""",
    "page_gates": f"""WITH {R.OFFERS}, {_ITEMS}, {_PROFILE}, q AS (SELECT *, CASE WHEN dated = 0 THEN 0 WHEN target_count > 0 THEN least(1, greatest(0.35, coverage, target_count / dated)) WHEN dated < least(2, items) THEN greatest(0.1, coverage * 0.5) WHEN newer = 0 OR older = 0 THEN greatest(0.35, coverage)
        WHEN dom >= 0.7 THEN greatest(0.30, coverage * dom) ELSE greatest(0.25, coverage * dom) END AS confidence, (page % 7 = 0 OR page % 5 <> 0) AND feed % 9 <> 0 AND NOT (feed % 2 = 0 AND page = 3) AS sound FROM prof),
      v AS (SELECT *, CASE WHEN NOT (sound AND relation <> 'unknown' AND (items = 0 OR dated >= 2 OR relation = 'target')) THEN 'structural' WHEN page % 4 = 0 THEN 'browser-safe' WHEN items = 0 THEN 'http-empty-needs-confirm' WHEN relation = 'mixed' THEN 'http-mixed-needs-confirm'
        WHEN dated < 3 THEN 'http-low-dated-evidence' WHEN confidence < 0.30 THEN 'http-low-confidence' WHEN relation = 'target' AND target_count < 2 THEN 'http-single-target-needs-confirm' ELSE 'http-high-confidence' END AS reason FROM q)
      SELECT feed, page, reason IN ('browser-safe', 'http-high-confidence') AS safe, reason, feed % 9 <> 0 AND page % 5 <> 0 AND page <> 3 AND (items = 0 OR dated >= 2 OR coverage >= 0.2) AS trusted FROM v""",
    "queue_positions": f"WITH {R.SCANS} SELECT scan_id, row_number() OVER (ORDER BY finished_at, scan_id) AS position FROM scans WHERE status = 'queued'",
    "active_scans": f"WITH {R.SCANS} SELECT count(*) FILTER (status IN ('queued', 'running', 'cancelling') AND finished_at > {_T}) AS active, count(*) AS scans FROM scans",
    "running_counters": f"WITH {R.SCANS} SELECT user_id, count(*) AS payments_count, round(sum(amount), 2) AS paid_total FROM scans WHERE status = 'done' GROUP BY 1",
    "shadow_starts": f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1997-05-01' + to_days(CAST(c_custkey % 28 AS INTEGER)) ELSE {_T} - INTERVAL 6 HOUR END AS start FROM customer",
    "due_observations": f"""WITH {R.OFFERS}, x AS (SELECT ordinal AS candidate_id, external_id, unnest([1, 3, 6]) AS target_hours, posted_at, view_count, l_linenumber FROM offers WHERE l_linenumber = 1)
      SELECT candidate_id, target_hours, posted_at + to_hours(target_hours) AS due_at, view_count FROM x WHERE posted_at + to_hours(target_hours) <= {_T} ORDER BY due_at, candidate_id, target_hours LIMIT 50""",
    "network_candidates": f"""WITH {R.OFFERS}, a AS (SELECT l_orderkey AS page, 'https://h/' || CASE l_linenumber WHEN 1 THEN 's-vac-inc-get.json?id=' WHEN 2 THEN 'api/Views/' WHEN 6 THEN 'api/Views/' ELSE 'static/' END || quantity % 4 AS url,
        CASE WHEN l_linenumber = 1 THEN 18 ELSE 0 END + CASE WHEN l_linenumber IN (2, 6) THEN 4 ELSE 0 END + CASE WHEN l_linenumber % 2 = 1 THEN 3 ELSE 0 END + CASE WHEN view_count = 12 THEN 2 ELSE 0 END AS score, ordinal FROM offers WHERE view_count IS NOT NULL),
      b AS (SELECT * FROM a WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page, url ORDER BY score DESC, ordinal) = 1)
      SELECT page, url, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, url) AS INTEGER) AS place FROM b QUALIFY place <= 8""",
    "outbox_events": f"""WITH {R.OFFERS}, x AS (SELECT ordinal AS candidate_id, {_MOD.format("quantity")} AS o, {_STAGE.format("quantity")} AS s, CASE WHEN l_linenumber <> 4 THEN {_MOD.format("price_eur")} END AS wo, CASE WHEN l_linenumber <> 4 THEN {_STAGE.format("price_eur")} END AS ws FROM offers),
      y AS (SELECT candidate_id, CASE WHEN o = 'confirmed' AND wo IS DISTINCT FROM 'confirmed' THEN 'confirmed' WHEN s = 'early_winner' AND ws IS DISTINCT FROM 'early_winner' THEN 'winner' END AS event FROM x) SELECT * FROM y WHERE event IS NOT NULL""",
    "counters_never_fall": "SELECT user_id, max(event_id % 97) AS pages, max(event_id % 89) AS items FROM events GROUP BY 1",
    "requested_views": "SELECT job, ordinal, url, p_size AS views FROM (SELECT DISTINCT l_orderkey AS job, l_linenumber AS ordinal, l_partkey AS url FROM lineitem) LEFT JOIN part ON p_partkey = url AND p_size % 3 <> 0",
    "payment_states": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'paid' WHEN o_orderkey % 4 = 0 THEN 'paid' WHEN o_orderkey % 4 = 1 THEN 'failed' WHEN o_orderkey % 4 = 2 OR TIMESTAMP '1995-01-01' > o_orderdate + INTERVAL 15 MINUTE THEN 'expired' ELSE 'pending' END AS state,
      CASE WHEN round_even(o_totalprice - 1000, 2) > 0 AND round_even(o_totalprice - 1000, 2) <= 100000 THEN round_even(o_totalprice - 1000, 2) END AS price FROM orders""",
    "fresh_offers": f"WITH {R.OFFERS} SELECT external_id FROM offers WHERE view_count IS NOT NULL AND ordinal % 3000 BETWEEN 5 AND 1440",
    "time_values": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-07-10 22:00:00' + to_hours(hour(ts)) + to_minutes(minute(ts)) WHEN event_id % 7 <> 0 THEN ts ELSE TIMESTAMP '2024-07-10 22:30:00' END AS moment,
      CAST(greatest(0, least(4, DATE '2024-07-11' - CAST(ts AS DATE))) AS INTEGER) AS age_days, event_id % 180 > 90 AS missed, ts >= TIMESTAMP '2024-01-19 18:00:00' AS young FROM events WHERE ts IS NOT NULL""",
    "category_counts": f"""WITH RECURSIVE {R.OFFERS}, w AS (SELECT DISTINCT [p_type, p_brand, string_split(p_name, ' ')[1]] AS w FROM part),
      dim AS (SELECT w[1] AS key, NULL AS parent FROM w UNION SELECT w[1] || '/' || w[2], w[1] FROM w UNION SELECT array_to_string(w, '/'), w[1] || '/' || w[2] FROM w),
      up AS (SELECT key, key AS above FROM dim UNION ALL SELECT up.key, dim.parent FROM up JOIN dim ON dim.key = up.above WHERE dim.parent IS NOT NULL)
      SELECT above AS category, string_split(above, '/')[1] AS root, count(*) AS listings FROM (SELECT category || '/' || string_split(title, ' ')[3] || '/' || string_split(title, ' ')[1] AS leaf FROM offers) JOIN up ON up.key = leaf GROUP BY 1, 2""",
    "chosen_categories": """WITH x AS (SELECT c_custkey, list_distinct(CASE c_custkey % 5 WHEN 0 THEN ['root'] WHEN 1 THEN ['c' || c_custkey % 4, 'other'] WHEN 2 THEN ['other', 'more'] ELSE ['c' || c_custkey % 4] END) AS s, CASE WHEN c_custkey % 7 = 0 THEN 'root' ELSE 'c' || (c_custkey // 5) % 4 END AS k FROM customer),
      y AS (SELECT *, list_contains(s, k) AS has, CASE WHEN k = 'root' THEN list_append(list_filter(s, lambda e: NOT starts_with(e, 'c')), k) ELSE list_append(list_filter(s, lambda e: e <> 'root'), k) END AS more, list_filter(s, lambda e: starts_with(e, 'c')) AS own, list_filter(s, lambda e: e <> 'root') AS kept FROM x),
      z AS (SELECT *, NOT has AND len(more) > 2 AS refused, list_filter(['c0', 'c1', 'c2', 'c3'], lambda e: NOT list_contains(kept, e)) AS missing, list_filter(list_concat(s, [k]), lambda e: starts_with(e, 'c') OR e = 'root') AS said FROM y),
      d AS (SELECT *, list_filter(said, lambda e, i: list_position(said, e) = i) AS v FROM z)
      SELECT c_custkey, array_to_string(list_sort(CASE WHEN has THEN list_filter(s, lambda e: e <> k) WHEN refused THEN s ELSE more END), ',') AS toggled, refused,
        array_to_string(list_sort(CASE WHEN len(own) > 0 THEN list_filter(s, lambda e: NOT starts_with(e, 'c')) ELSE list_concat(kept, missing[1:greatest(0, 2 - len(kept))]) END), ',') AS filled, len(own) = 0 AND len(missing) > greatest(0, 2 - len(kept)) AS short,
        array_to_string(v, ',') AS valid, CASE WHEN len(v) = 0 THEN 'none' WHEN len(v) > 2 THEN 'too many' END AS error FROM d""",
}
