"""Checkpoints of pages and days: live reads, failures, clean-up, payloads, gates (survey S19-S21, K2, K5, K9, X5-X8, F14-F16, X15).

Payloads are read as VARIANT, field by field, each with its default; what is no JSON object is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_TTL, INDEX_TTL = 300, 900
RELATIONS = ("target", "newer", "older", "mixed", "empty")
TERMINAL = ("done", "partial", "failed")


def live(rows: DataFrame, at: str, as_of: Column, seconds: int, verified: bool = True) -> DataFrame:
    """Rows that are not older than their time to live; verified: only those with that status."""
    young = F.col(at) >= as_of - F.expr(f"INTERVAL {seconds} SECONDS")
    return rows.filter(young & (F.col("status") == "verified") if verified else young)


def cleaned(tables: dict[str, tuple[DataFrame, str]], as_of: Column, hours: int = 24, job_days: int = 7) -> tuple[dict[str, DataFrame], DataFrame]:
    """K5: tables (name: rows and their time) without what is over, and one row of how many rows of each went. "jobs" are kept longer, and go only if they are over."""
    left, gone = {}, None
    for name, (rows, at) in tables.items():
        old = F.col(at) < as_of - F.expr(f"INTERVAL {max(1, hours)} HOURS")
        if name == "jobs":
            old = (F.col(at) < as_of - F.expr(f"INTERVAL {job_days} DAYS")) & F.col("status").isin(*TERMINAL)
        old = F.coalesce(old, F.lit(False))
        left[name] = rows.filter(~old)
        n = rows.agg(F.count_if(old).alias(name))
        gone = n if gone is None else gone.join(n, F.lit(True))
    return left, gone


def with_failures(checkpoints: DataFrame, failures: DataFrame, key: list[str]) -> DataFrame:
    """K2: checkpoints (key, status, attempts, error_text, checked_at) after failures (key, error_text, at): failed, one attempt more for each, the last error, cut at 500."""
    last = failures.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("_n"), F.max_by("error_text", "at").alias("_error"), F.max("at").alias("_at"))
    on = F.lit(True)
    for k in key:
        on = on & checkpoints[k].eqNullSafe(last[k])
    both = checkpoints.join(last, on, "full")
    hit = F.col("_n").isNotNull()
    return both.select(
        *[F.coalesce(checkpoints[k], last[k]).alias(k) for k in key], F.when(hit, "failed").otherwise(F.col("status")).alias("status"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("attempts"),
        F.when(hit, F.substring("_error", 1, 500)).otherwise(F.col("error_text")).alias("error_text"), F.coalesce("_at", "checked_at").alias("checked_at"),
    )


def marked(users: DataFrame, marks: DataFrame) -> DataFrame:
    """Users with expiring_sent_for and expired_sent_for set by marks (user_id, access_until, kind: warning or expired), only where access_until is still what the mark has seen."""
    seen = marks.groupBy("user_id", "access_until").agg(F.bool_or(F.col("kind") == "warning").alias("_w"), F.bool_or(F.col("kind") == "expired").alias("_e")).withColumnsRenamed({"user_id": "_u", "access_until": "_a"})
    both = users.join(seen, (users["user_id"] == seen["_u"]) & users["access_until"].eqNullSafe(seen["_a"]), "left")
    now = {"expiring_sent_for": F.when(F.col("_w"), F.col("access_until")).otherwise(F.col("expiring_sent_for")), "expired_sent_for": F.when(F.col("_e"), F.col("access_until")).otherwise(F.col("expired_sent_for"))}
    return both.withColumns(now).drop("_u", "_a", "_w", "_e")


def left_over(jobs: DataFrame, partial: DataFrame) -> DataFrame:
    """The distinct addresses (job_id, url) of jobs that have no result yet."""
    return jobs.select("job_id", "url").distinct().join(partial.select("job_id", "url").distinct(), ["job_id", "url"], "left_anti")


# ---- payloads --------------------------------------------------------------------------------------------------------


def encoded(info: Column) -> Column:
    """K9."""
    return F.to_json(info, {"ignoreNullFields": "false"})


def _once(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), for which x is computed once, however often it is named there."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def _object(raw: Column, of: Callable[[Column], Column]) -> Column:
    """of the payload as VARIANT, parsed once."""
    return _once(F.try_parse_json(raw), lambda v: _once(F.when(F.schema_of_variant(v).startswith("OBJECT"), v), of))


def _get(v: Column, field: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", kind)


def _int(v: Column, field: str, default: int | None = None) -> Column:
    """A whole number, from a number with or without a fraction or from digits."""
    whole = lambda said: F.when(said.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(said).try_cast("long")).otherwise(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")) != "STRING", _get(v, field, "double").try_cast("long")))
    n = _once(_get(v, field, "string"), whole)
    return n if default is None else F.coalesce(F.nullif(n, F.lit(0)), F.lit(default))


def decoded_page(raw: Column) -> Column:
    """The page's struct; items without an id or address, and links without an address, are left out; null if it is no object or a price is no number."""
    return _object(raw, lambda v: _once(_items(v), lambda items: F.when(v.isNotNull() & ~F.exists(items, lambda i: i["bad"]), _page(v, F.transform(items, lambda i: i["item"])))))


def _text(v: Column, field: str) -> Column:
    return F.coalesce(_get(v, field, "string"), F.lit(""))


def _items(v: Column) -> Column:
    """The items that are known, each read once: item, and bad for a price that is no number. What is no object has no id."""
    price = lambda i: F.struct(_get(i, "price_eur", "string").isNotNull().alias("said"), _int(i, "price_eur").alias("n"))
    item = lambda i, p: F.struct(_text(i, "external_id").alias("external_id"), _text(i, "title").alias("title"), _get(i, "price_text", "string").alias("price_text"), p["n"].cast("int").alias("price_eur"), _text(i, "url").alias("url"), _get(i, "posted_text", "string").alias("posted_text"))
    read = F.transform(F.coalesce(_get(v, "items", "array<variant>"), F.array().cast("array<variant>")), lambda i: _once(price(i), lambda p: F.struct(item(i, p).alias("item"), (p["said"] & p["n"].isNull()).alias("bad"))))
    return F.filter(read, lambda i: (i["item"]["external_id"] != "") & (i["item"]["url"] != ""))


def _page(v: Column, items: Column) -> Column:
    pairs = F.coalesce(_get(v, "location_shards", "array<variant>"), F.array().cast("array<variant>"))
    at = lambda p, k, kind: F.try_variant_get(p, f"$[{k}]", kind)
    links = F.transform(F.filter(pairs, lambda p: F.coalesce(at(p, 0, "string"), F.lit("")) != ""), lambda p: F.struct(at(p, 0, "string").alias("url"), at(p, 1, "long").alias("count")))
    fields = [_int(v, f).cast("int").alias(f) for f in ("result_start", "result_end", "total_results", "actual_page", "max_page")]
    counts = [_int(v, f, 0).cast("int").alias(f) for f in ("raw_candidates", "promoted_filtered", "duplicate_cards", "missing_date_count", "missing_price_count")]
    return F.struct(
        F.greatest(F.lit(1), _int(v, "requested_page", 1)).cast("int").alias("requested_page"), _text(v, "final_url").alias("final_url"), items.alias("items"), *fields,
        F.coalesce(_get(v, "request_matches_page", "boolean"), F.lit(True)).alias("request_matches_page"), F.coalesce(_get(v, "page_verified", "boolean"), F.lit(False)).alias("page_verified"), _text(v, "fingerprint").alias("fingerprint"), *counts,
        F.filter(F.coalesce(_get(v, "promoted_ids", "array<string>"), F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) != "").alias("promoted_ids"), F.coalesce(_get(v, "date_coverage", "double"), F.lit(0.0)).alias("date_coverage"),
        F.coalesce(_get(v, "suspicious", "boolean"), F.lit(False)).alias("suspicious"), links.alias("location_shards"),
    )


def decoded_probe(raw: Column) -> Column:
    """A probe's struct; null if its relation is none of those that there are."""
    return _object(raw, lambda v: F.when(F.coalesce(_get(v, "relation", "string").isin(*RELATIONS), F.lit(False)), _probe(v)))


def _probe(v: Column) -> Column:
    day = lambda f: _text(v, f).alias(f)
    return F.struct(
        F.greatest(F.lit(1), _int(v, "page", 1)).cast("int").alias("page"), _get(v, "relation", "string").alias("relation"), _int(v, "max_page").cast("int").alias("max_page"), _int(v, "actual_page").cast("int").alias("actual_page"), F.coalesce(_get(v, "date_coverage", "double"), F.lit(0.0)).alias("date_coverage"),
        *[_int(v, f, 0).cast("int").alias(f) for f in ("target_count", "newer_count", "older_count")], day("newest_day"), day("oldest_day"), F.coalesce(F.nullif(_get(v, "source", "string"), F.lit("")), F.lit("remote")).alias("source"),
    )


def decoded_predictor(raw: Column) -> Column:
    """A confirmed page from 1 to 50 of a day; null if either is missing."""
    known = lambda v: F.struct(_int(v, "page").cast("int").alias("page"), _text(v, "target_date").alias("target_date"), F.coalesce(_get(v, "confirmed_at", "double"), F.lit(0.0)).alias("confirmed_at"))
    return _object(raw, lambda v: _once(known(v), lambda k: F.when(k["page"].between(1, 50) & (k["target_date"] != ""), k)))


def encoded_result(result: Column) -> Column:
    """X7, of a struct views, raw_text, source, final_url, page_title, error: texts are cut at 400, titles at 200."""
    cut = lambda f, n: F.substring(result[f], 1, n).alias(f)
    source = F.coalesce(F.nullif(result["source"], F.lit("")), F.lit("remote:unknown"))
    return encoded(F.struct(result["views"].alias("views"), cut("raw_text", 400), source.alias("source"), result["final_url"].alias("final_url"), cut("page_title", 200), cut("error", 400)))


# ---- gates -----------------------------------------------------------------------------------------------------------


def structural(matches: Column, verified: Column, suspicious: Column) -> Column:
    """F14; unknown counts as matching, not verified and not suspicious."""
    return F.coalesce(matches, F.lit(True)) & F.coalesce(verified, F.lit(False)) & ~F.coalesce(suspicious, F.lit(False))


def probe_verdict(sound: Column, relation: Column, items: Column, dated: Column, confidence: Column, target_count: Column, strict: Column) -> Column:
    """struct safe, reason of a probed page. sound: see structural(); strict: what has come the cheap way has to show more."""
    base = sound & relation.isin(*RELATIONS) & ((items == 0) | (dated >= 2) | (relation == "target"))
    reason = (
        F.when(~base, "structural").when(~strict, "browser-safe").when(items == 0, "http-empty-needs-confirm").when(relation == "mixed", "http-mixed-needs-confirm").when(dated < 3, "http-low-dated-evidence")
        .when(confidence < 0.30, "http-low-confidence").when((relation == "target") & (target_count < 2), "http-single-target-needs-confirm").otherwise("http-high-confidence")
    )
    return F.struct(reason.isin("browser-safe", "http-high-confidence").alias("safe"), reason.alias("reason"))


def is_today(text: Column) -> Column:
    """F16."""
    return F.coalesce(text.rlike(r"(?iU)\bHeute\b"), F.lit(False))
