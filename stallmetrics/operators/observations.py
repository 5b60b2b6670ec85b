"""Scheduled measurements of candidates as tables (survey Q15-Q16, Q21, J3-J6, K4-K8, R1-R7, O9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import newest

HOURS = (1, 3, 6)
LATE_MINUTES, REUSE_MINUTES, RETRY_MINUTES, MOST_ATTEMPTS = 90, 15, 15, 3


def _minutes(n: int) -> Column:
    return F.expr(f"INTERVAL {n} MINUTES")


def plan(candidates: DataFrame, hours: tuple[int, ...] = HOURS) -> DataFrame:
    """One pending observation of each candidate for each checkpoint."""
    due = F.col("baseline_at") + F.make_dt_interval(hours=F.col("target_hours"))
    return candidates.select("*", F.explode(F.array(*map(F.lit, hours))).alias("target_hours")).withColumns({"due_at": due, "status": F.lit("pending"), "attempts": F.lit(0)})


def next_scan(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """The oldest complete scan with rows that has no run yet."""
    ready = scans.filter("status = 'done' AND is_complete AND rows > 0")
    return ready.join(runs.select("scan_id").distinct(), "scan_id", "left_anti").orderBy("finished_at", "scan_id").limit(1)


def triage(observations: DataFrame, listings: DataFrame, as_of: Column) -> DataFrame:
    """Due observations: missed (late and never tried), reusable (the listing has a fresh value), else remote."""
    due = observations.filter((F.col("status") == "pending") & (F.col("due_at") <= as_of))
    both = due.join(listings.select("external_id", "view_count", "views_checked_at"), "external_id")
    late = (as_of - _minutes(LATE_MINUTES) > F.col("due_at")) & (F.col("attempts") == 0)
    fresh = F.col("view_count").isNotNull() & (F.col("views_checked_at") >= F.col("due_at") - _minutes(REUSE_MINUTES)) & (F.col("views_checked_at") > F.col("baseline_at"))
    return both.withColumn("action", F.when(late, "missed").when(F.coalesce(fresh, F.lit(False)), "reusable").otherwise("remote"))


def due(observations: DataFrame, candidates: DataFrame, listings: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """Pending observations that are due, with their candidate and its listing; the `limit` that have waited longest."""
    pending = observations.filter((F.col("status") == "pending") & (F.col("due_at") <= as_of))
    return pending.join(candidates, "candidate_id").join(listings, "external_id").orderBy("due_at", "candidate_id", "target_hours").limit(limit)


def shadow_start(setting: Column, as_of: Column, backfill_minutes: int) -> Column:
    """The start that was written once, or so many minutes ago where there is none that can be read."""
    return F.coalesce(setting.try_cast("timestamp"), as_of - _minutes(backfill_minutes))


# The counter's address and words that speak of one.
ENDPOINT, KEYWORDS = r"(?i)/s-vac-inc-get\.json(?:\?|$)", ("view", "views", "viewcount", "counter", "cntr", "aufruf", "impression")


def network_candidates(answers: DataFrame, by: list[str], order: str, top: int = 8) -> DataFrame:
    """The likeliest sources of a page's counter among its network answers (url, body, passive_views, views: what the page shows), with score and place.

    An address counts once with its best answer (the first of equal ones); what has no sign of a counter is left out.
    """
    has = lambda text: F.exists(F.array(*map(F.lit, KEYWORDS)), lambda w: F.lower(text).contains(w))
    passive = F.col("url").rlike(ENDPOINT)
    shown = F.regexp_extract_all("body", F.lit(r"\d+"), F.lit(0))
    points = lambda when, n: F.when(F.coalesce(when, F.lit(False)), n).otherwise(0)
    score = points(passive, 10) + points(passive & F.col("passive_views").isNotNull(), 8) + points(has(F.col("url")), 4) + points(has(F.col("body")), 3) + points(F.array_contains(shown, F.col("views").cast("string")), 2)
    scored = answers.withColumn("score", score).filter("score > 0")
    best = Window.partitionBy(*by, "url").orderBy(F.desc("score"), order)
    ranked = Window.partitionBy(*by).orderBy(F.desc("score"), "url")
    once = scored.withColumn("place", F.row_number().over(best)).filter("place = 1")
    return once.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= top)


def retried(failed: DataFrame, as_of: Column) -> DataFrame:
    """Failed attempts are due again later, or end as errors."""
    over = F.col("attempts") >= MOST_ATTEMPTS
    return failed.withColumn("due_at", F.when(over, F.col("due_at")).otherwise(as_of + _minutes(RETRY_MINUTES))).withColumn("status", F.when(over, "error").otherwise("pending"))


def recovered(rows: DataFrame, as_of: Column, minutes: int = 20) -> DataFrame:
    """Rows that have run for too long are pending again."""
    stale = (F.col("status") == "running") & (F.col("started_at") < as_of - _minutes(minutes))
    return rows.withColumns({"recovered": F.coalesce(stale, F.lit(False)), "status": F.when(stale, "pending").otherwise(F.col("status"))})


def latest(rows: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The last version of each key; a union of old and new rows upserts."""
    return newest(rows, key, [F.desc_nulls_last(at), F.desc_nulls_last(tie)])


def monotone_counters(rows: DataFrame, key: list[str], counters: list[str]) -> DataFrame:
    """K4: counters never fall."""
    return rows.groupBy(*key).agg(*[F.max(c).alias(c) for c in counters])


def accepted_measurements(current: DataFrame, measured: DataFrame) -> DataFrame:
    """Measurements in their order of arrival (seq) that aren't older than what was known when they came; history gets these only."""
    before = Window.partitionBy("external_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.greatest(F.col("views_checked_at"), F.max("measured_at").over(before))
    both = measured.join(current.select("external_id", "views_checked_at"), "external_id")
    return both.withColumn("known_at", known).filter(F.col("known_at").isNull() | (F.col("measured_at") >= F.col("known_at"))).drop("views_checked_at")


def outbox(before: DataFrame, after: DataFrame) -> DataFrame:
    """K8: an event for each candidate whose outcome or stage has just become one that is told."""
    joined = after.join(before.select("candidate_id", F.col("outcome").alias("was"), F.col("stage").alias("stage_was")), "candidate_id", "left")
    kind = F.when((F.col("outcome") == "confirmed") & ~F.col("was").eqNullSafe("confirmed"), "confirmed").when((F.col("stage") == "early_winner") & ~F.col("stage_was").eqNullSafe("early_winner"), "winner")
    return joined.withColumn("event", kind).filter("event IS NOT NULL").drop("was", "stage_was")


def missing_users(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Users of scans that have no row yet."""
    return scans.select("user_id").distinct().join(users.select("user_id"), "user_id", "left_anti")


def in_order(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """What was found for each requested key, null where nothing was, by ordinal."""
    return requested.join(found, key, "left").orderBy("ordinal")
