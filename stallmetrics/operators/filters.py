"""Filters, keep-newest and the settings pipeline of a result (survey F1-F9, F13-F22, N5, O1-O3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NOISE_WORDS, contains_any

# Named price ranges.
PRICE_RANGES = {"any": (None, None), "50_plus": (50, None), "100_plus": (100, None), "200_plus": (200, None), "500_plus": (500, None), "0_50": (0, 50), "50_100": (50, 100), "100_200": (100, 200), "200_500": (200, 500)}


@dataclass(frozen=True)
class Settings:
    """A user's result settings; the query of entry point A."""

    output_mode: str = "all"
    smart_dedupe: bool = False
    clean_noise: bool = False
    price_filter: str = "any"
    min_views: int = 0
    sort_mode: str = "newest"
    include_words: str = ""
    exclude_words: str = ""


def price_bounds(name: str | None) -> tuple[int | None, int | None]:
    """bounds of a named or custom:lo:hi range; what isn't one has none."""
    name = (name or "any").strip()
    if name in PRICE_RANGES:
        return PRICE_RANGES[name]
    kind, *ends = name.split(":", 2)
    if kind != "custom" or len(ends) != 2:
        return None, None
    try:
        low, high = (int(x) if x else None for x in ends)
    except ValueError:
        return None, None
    return (None, None) if low is not None and high is not None and low > high else (low, high)


def _listed(words: str) -> list[str]:
    return [w.strip() for w in words.split(",") if w.strip()]


def base_filter(rows: DataFrame, s: Settings, since: Column | None = None) -> DataFrame:
    """conjunction of the settings' predicates; a null price or view count fails a bound. Titles by column normal."""
    low, high = price_bounds(s.price_filter)
    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col("posted_at") >= since)
    if low is not None:
        keep = keep & (F.col("price_eur") >= low)
    if high is not None:
        keep = keep & (F.col("price_eur") <= high)
    if s.min_views > 0:
        keep = keep & (F.col("view_count") >= s.min_views)
    if s.clean_noise:
        keep = keep & ~contains_any(F.col("normal"), NOISE_WORDS)
    if include := _listed(s.include_words):
        keep = keep & contains_any(F.col("normal"), include)
    if exclude := _listed(s.exclude_words):
        keep = keep & ~contains_any(F.col("normal"), exclude)
    return rows.filter(keep)


def keep_newest(rows: DataFrame, keys: list[str | Column], newest: str = "posted_at") -> DataFrame:
    """Of equal keys the row with the latest time, of equal times the one that came first (ordinal).

    The first row of each key: Spark keeps one row of a key in each partition before it shuffles.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(newest), "ordinal"))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def unique_families(rows: DataFrame, confidence: int = 35) -> DataFrame:
    """Q2: rows whose (category, family_key) occurs once, with enough confidence."""
    once = rows.filter("family_key <> ''").groupBy("category", "family_key").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("*")).alias("_row")).filter("_n = 1")
    return once.select("_row.*").filter(F.col("family_confidence") >= confidence)


def ordering(mode: str) -> list[Column]:
    """O1: null prices last both ways, then newest, then as they came."""
    newest = [F.desc("posted_at"), F.asc("ordinal")]
    return {"price_asc": [F.asc_nulls_last("price_eur"), *newest], "price_desc": [F.desc_nulls_last("price_eur"), *newest]}.get(mode, newest)


def apply_settings(rows: DataFrame, s: Settings, output_mode: bool = True) -> DataFrame:
    """Filter, then unique families or one of each duplicate, then order. rows: columns duplicate_key, normal, family_key too."""
    found = base_filter(rows, s)
    if output_mode and s.output_mode == "unique":
        found = unique_families(found)
    elif s.smart_dedupe and s.output_mode != "frequent":
        found = keep_newest(found, ["duplicate_key"])
    return found.orderBy(*ordering(s.sort_mode))


def has_access(mode: str, is_admin: Column, is_banned: Column, access_until: Column, as_of: Column) -> Column:
    """admins always; banned never; else by mode, and at last by subscription."""
    if mode not in ("open", "admin_only"):
        rest = F.coalesce(access_until > as_of, F.lit(False))
    else:
        rest = F.lit(mode == "open")
    return F.when(is_admin, True).when(is_banned, False).otherwise(rest)


def invoice_matches(currency: Column, amount: Column, expected: Column) -> Column:
    """right currency and, as decimals, at most 0.001 apart."""
    exact = lambda x: x.cast("decimal(18,6)")
    return F.coalesce((F.upper(currency) == "USDT") & (F.abs(exact(amount) - exact(expected)) <= F.lit("0.001").cast("decimal(18,6)")), F.lit(False))


def notices(users: DataFrame, as_of: Column) -> DataFrame:
    """users whose access ends or has ended within a day and who haven't been told of that end; column notice: expiring, expired."""
    day = F.expr("INTERVAL 24 HOURS")
    until = F.col("access_until")
    users = users.filter(~F.coalesce("is_banned", F.lit(False)))
    kind = F.when((until > as_of) & (until <= as_of + day) & ~F.col("expiring_sent_for").eqNullSafe(until), "expiring").when((until <= as_of) & (until >= as_of - day) & ~F.col("expired_sent_for").eqNullSafe(until), "expired")
    return users.withColumn("notice", kind).filter("notice IS NOT NULL")


def find_users(users: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """by id or name; newest first."""
    match = F.lower("username").contains(needle.lower()) | F.lower("first_name").contains(needle.lower())
    if needle.isdigit():
        match = match | (F.col("user_id") == int(needle))
    return users.filter(match).orderBy(F.desc("created_at"), "user_id").limit(limit)


def fresh(rows: DataFrame, max_age_hours: int = 24) -> DataFrame:
    """F8: a known view count and an exact age of five minutes to the limit."""
    return rows.filter(F.col("views").isNotNull() & F.col("age_minutes").between(5, max_age_hours * 60))


def page_trusted(verified: Column, matches: Column, suspicious: Column, items: Column, dated: Column, coverage: Column) -> Column:
    """a verified page whose dates can be relied on."""
    return verified & matches & ~suspicious & ((items == 0) | (dated >= 2) | (coverage >= 0.20))
