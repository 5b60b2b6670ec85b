"""Market profiles of product families (survey Q10, A8-A11, J1, J8, J9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clamp, mid_rank
from ..functions.timeparse import micros
from ..shared import stored

PROFILE = ("median", "count", "supply_percentile", "recent_count", "previous_count", "supply_growth_ratio", "demand_recent_median", "demand_previous_median", "demand_growth_ratio", "demand_recent_samples", "demand_previous_samples", "prior_signals", "prior_confirmed")
#: What a family without a profile has: neutral values, no bonus for the unknown.
NEUTRAL = {"count": 0, "supply_percentile": 0.0, "recent_count": 0, "previous_count": 0, "supply_growth_ratio": 1.0, "demand_growth_ratio": 1.0, "demand_recent_samples": 0, "demand_previous_samples": 0, "prior_signals": 0, "prior_confirmed": 0}


def supply(listings: DataFrame, as_of: Column, days: int = 30, window: int = 7) -> DataFrame:
    """By (category, family_key) counts of all, recent and previous ads; the median price; the family's mid-rank in its category; growth against the category's."""
    ago = lambda n: as_of - F.make_dt_interval(F.lit(n))
    seen = F.coalesce(F.col("first_seen_at"), ago(days))
    there = listings.filter((F.col("first_seen_at") >= ago(days)) & ~F.col("is_promoted") & (F.col("family_key") != ""))
    family = there.groupBy("category", "family_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile(F.when(F.col("price_eur") > 0, F.col("price_eur").cast("double")), F.lit(0.5)).alias("median"),
        F.count_if(seen >= ago(window)).alias("recent"),
        F.count_if((seen < ago(window)) & (seen >= ago(2 * window))).alias("previous"),
    )
    category = family.groupBy("category").agg(F.sum("recent").alias("_cr"), F.sum("previous").alias("_cp"))
    grown = ((F.col("recent") + 1) / (F.col("previous") + 1)) / F.greatest(F.lit(0.25), (F.col("_cr") + 2) / (F.col("_cp") + 2))
    ranked = mid_rank(family, "n", ["category"], "supply_percentile", alone=0.5)
    return ranked.join(category, "category").withColumn("supply_growth_ratio", clamp(grown, 0.25, 4.0)).drop("_cr", "_cp")


def demand(views: DataFrame, listings: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """By family_key the median of its ads' views per hour (first to last point, half an hour apart or more) and their number."""
    known = listings.filter((F.col("first_seen_at") >= start) & ~F.col("is_promoted") & (F.col("family_key") != ""))
    seen = views.filter(F.col("recorded_at") >= start)
    if end is not None:
        known = known.filter(F.col("first_seen_at") < end)
        seen = seen.filter(F.col("recorded_at") < end + F.make_dt_interval(F.lit(2)))
    # Points become two of each ad before the join, so only series are shuffled on.
    points = seen.groupBy("external_id").agg(
        F.min_by("view_count", F.struct("recorded_at", "id")).alias("first_views"), F.max_by("view_count", F.struct("recorded_at", "id")).alias("last_views"),
        F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"), F.count(F.lit(1)).alias("points"),
    )
    hours = (micros("last_at") - micros("first_at")) / 3.6e9
    gained = F.coalesce("last_views", F.lit(0)) - F.coalesce("first_views", F.lit(0))
    rates = points.filter(F.col("points") >= 2).withColumn("hours", hours).filter((F.col("hours") >= 0.5) & (gained >= 0)).withColumn("rate", gained / F.col("hours"))
    return rates.join(known.select("external_id", "family_key"), "external_id").groupBy("family_key").agg(F.percentile("rate", F.lit(0.5)).alias("rate"), F.count(F.lit(1)).alias("samples"))


def prior(candidates: DataFrame, since: Column) -> DataFrame:
    """By family_key how many former candidates scored 65 or more, and how many were confirmed."""
    mine = candidates.filter((F.col("created_at") >= since) & ~F.col("is_control") & (F.col("cohort_key") != ""))
    return mine.groupBy(F.col("cohort_key").alias("family_key")).agg(F.count_if(F.col("current_score") >= 65).alias("prior_signals"), F.count_if(F.col("outcome") == "confirmed").alias("prior_confirmed"))


def market_profile(targets: DataFrame, listings: DataFrame, views: DataFrame, candidates: DataFrame, as_of: Column, days: int = 30, window: int = 7) -> DataFrame:
    """Q10: one row of PROFILE for each target (category, family_key). A family's count spans categories, its percentile doesn't."""
    ago = lambda n: as_of - F.make_dt_interval(F.lit(n))
    keys = targets.filter("family_key <> ''").groupBy("family_key").agg(F.max("category").alias("category"))
    listings = listings.join(targets.select("category").distinct(), "category", "left_semi")
    by_category = supply(listings, as_of, days, window)
    total = by_category.groupBy("family_key").agg(F.sum("n").alias("count"), F.sum("recent").alias("recent_count"), F.sum("previous").alias("previous_count"))
    own = by_category.select("category", "family_key", "median", "supply_percentile", "supply_growth_ratio")
    recent = demand(views, listings, ago(window)).withColumnsRenamed({"rate": "demand_recent_median", "samples": "demand_recent_samples"})
    before = demand(views, listings, ago(2 * window), ago(window)).withColumnsRenamed({"rate": "demand_previous_median", "samples": "demand_previous_samples"})
    out = keys.join(own, ["category", "family_key"], "left")
    for other in (total, recent, before, prior(candidates, ago(days))):
        out = out.join(other, "family_key", "left")
    ratio = F.when((F.col("demand_previous_median") > 0) & F.col("demand_recent_median").isNotNull(), clamp(F.col("demand_recent_median") / F.col("demand_previous_median"), 0.25, 4.0))
    out = out.withColumn("demand_growth_ratio", ratio).na.fill(NEUTRAL)
    return out.select("category", "family_key", *PROFILE)


def lookup(rows: DataFrame, profiles: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows with the profile of the first of their keys that has one; without any the neutral values.

    Rows with the same keys have the same profile, so it is looked up once for each different list of keys: one join on
    exploded keys instead of one for each alternative, and an aggregate for the first hit. Written, so that its size is known
    and it is broadcast where it is small.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.withColumns(dict(zip(names, keys, strict=True)))
    tried = keyed.select(*names).distinct().select("*", F.posexplode(F.array(*names)).alias("_try", "_key"))
    values = profiles.select(F.col("family_key").alias("_pk"), F.struct(*PROFILE).alias("_profile"))
    met = tried.join(values, tried["_key"] == values["_pk"], "left")
    first = F.min_by("_profile", F.when(F.col("_profile").isNotNull(), F.col("_try")))
    found = stored(met.groupBy(*[F.col(k).alias(f"{k}_") for k in names]).agg(first.alias("_profile")), "lookup")
    out = keyed.join(found, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in names])
    return out.select(*rows.columns, *[F.coalesce(F.col("_profile").getField(c), F.lit(NEUTRAL[c])).alias(f"market_{c}") if c in NEUTRAL else F.col("_profile").getField(c).alias(f"market_{c}") for c in PROFILE])
