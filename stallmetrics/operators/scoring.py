"""Opportunity scores, the shortlist, and re-scoring as measurements come in (survey Q11-Q14, A12-A13, N7-N8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..shared import stored
from .market import lookup

# Weights of the score's parts.
WEIGHTS = {"demand": 34.0, "anomaly": 26.0, "trend": 16.0, "imbalance": 12.0, "repeat": 8.0, "fresh": 3.0, "price": 1.0}


def balanced_rates(rows: DataFrame) -> DataFrame:
    """A category's rates with one for each cohort (its median) and one for each ad without; categories that have one only take all their ads'."""
    grouped = rows.filter("cohort_key <> ''").groupBy("category", "cohort_key").agg(S.percentile(F.col("vph"), 0.5).alias("rate")).select("category", "rate")
    single = rows.filter("cohort_key = ''").select("category", F.col("vph").alias("rate"))
    both = grouped.unionByName(single)
    few = both.groupBy("category").agg(F.count(F.lit(1)).alias("_n")).filter("_n < 2").select("category")
    return both.join(few, "category", "left_anti").unionByName(rows.join(few, "category", "left_semi").select("category", F.col("vph").alias("rate")))


def initial_scores(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Q11: features with cohort_key (T10), scored among their cohort and category.

    Category and cohort statistics are aggregates joined back, never windows over a category's ads.
    """
    rows = stored(features.withColumn("category", F.coalesce(F.nullif("category_key", F.lit("")), F.lit("unknown"))).withColumn("vph", S.views_per_hour(F.col("views"), F.col("age_minutes"))), "features")
    balanced, profiles = stored(balanced_rates(rows), "rates"), stored(profiles, "profiles")
    bare = F.when(F.col("cohort_key").startswith("id:"), F.substring(F.col("cohort_key"), 4, 10_000))
    rows = lookup(rows, profiles, [F.nullif("cohort_key", F.lit("")), F.nullif("identity_key", F.lit("")), bare])
    # What is joined back is written, so that its size is known and the ads are shuffled for large tables only.
    base = balanced.groupBy("category").agg(*S.percentiles(F.col("rate"), {"_p50": 0.5, "_p75": 0.75}))
    base = base.withColumn("category_median", F.greatest(F.lit(0.25), F.col("_p50"))).withColumn("category_p75", F.greatest("category_median", "_p75")).drop("_p50", "_p75")
    whole = rows.groupBy("category").agg(F.count(F.lit(1)).alias("category_size"), *S.percentiles(F.col("vph"), {"_q50": 0.5, "_q85": 0.85, "_q90": 0.9}))
    rows = rows.join(stored(base.join(whole, "category"), "categories"), "category")
    cohort = rows.filter("cohort_key <> ''").groupBy("category", "cohort_key").agg(F.count(F.lit(1)).alias("peers"), F.count_if(F.col("vph") >= F.col("category_p75")).alias("strong"), *S.percentiles(F.col("vph"), {"c0": 0.5, "c1": 0.85, "c2": 0.9}))
    rows = rows.join(stored(cohort, "cohorts"), ["category", "cohort_key"], "left").na.fill(0, ["peers", "strong"])
    rows = S.mid_rank(rows, "views", ["category"], "views_percentile")
    rows = S.mid_rank_among(rows, "vph", balanced, "rate", ["category"], "velocity_percentile")

    c = F.col
    cohorts = c("peers") >= 3
    peer = lambda i, q: F.when(cohorts, c(f"c{i}")).otherwise(c(f"_q{q}"))
    rows = rows.withColumns({
        "peer_count": F.when(cohorts, c("peers")).otherwise(c("category_size")).cast("int"),
        "peer_median": peer(0, 50), "peer_p85": peer(1, 85), "peer_p90": peer(2, 90),
        "category_ratio": c("vph") / c("category_median"),
        "family_rate": F.when(c("peers") >= 2, c("c0")).otherwise(c("vph")),
        "history_samples": c("market_demand_recent_samples") + c("market_demand_previous_samples"),
        "saturation": S.saturation(c("market_supply_percentile"), F.when(c("cohort_key") != "", c("peers") / c("category_size")).otherwise(0.0), c("market_count")),
    })
    rows = rows.withColumns({
        "peer_ratio": F.when(cohorts, c("vph") / F.greatest(F.lit(0.25), c("peer_median"))).otherwise(c("category_ratio")),
        "vs_history": F.when((c("market_demand_recent_median") > 0) & (c("market_demand_recent_samples") >= 2), c("family_rate") / F.greatest(F.lit(0.25), c("market_demand_recent_median"))),
        "_grown": F.when(c("market_demand_recent_median").isNotNull() & (c("market_demand_previous_median") > 0) & (c("history_samples") >= 4), c("market_demand_recent_median") / F.greatest(F.lit(0.25), c("market_demand_previous_median"))),
        "_now": F.when(c("peers") > 0, 0.65 * c("strong") / c("peers") + 0.35 * S.clamp((c("peers") - 1) / 4.0)).otherwise(0.28),
        "supply_growth": S.clamp(F.when(c("market_supply_growth_ratio") != 0, c("market_supply_growth_ratio")).otherwise(1.0), 0.25, 4.0),
    })
    rows = rows.withColumns({
        "trend_evidence": S.combined_growth(c("vs_history"), c("_grown")).isNotNull(),
        "demand_growth": F.coalesce(S.combined_growth(c("vs_history"), c("_grown")), F.lit(1.0)),
        "repeatability": S.clamp(F.when(c("market_prior_signals") > 0, 0.65 * c("_now") + 0.35 * c("market_prior_confirmed") / c("market_prior_signals")).otherwise(c("_now"))),
        "anomaly_ratio": F.greatest(c("category_ratio"), F.coalesce("vs_history", F.lit(0.0))),
    })
    rows = rows.withColumn("demand_supply", F.when(c("trend_evidence"), S.clamp(c("demand_growth") / F.greatest(F.lit(0.5), c("supply_growth")), 0.25, 4.0)).otherwise(1.0))
    with_history = 0.42 * S.ratio_factor(c("category_ratio")) + 0.18 * S.ratio_factor(c("peer_ratio")) + 0.40 * S.growth_factor(c("vs_history"))
    without = 0.72 * S.ratio_factor(c("category_ratio")) + 0.28 * S.ratio_factor(c("peer_ratio"))
    parts = {
        "demand": 0.68 * c("velocity_percentile") + 0.32 * S.demand_factor(c("views"), c("vph")),
        "anomaly": F.when(c("vs_history").isNotNull(), with_history).otherwise(without),
        "trend": F.when(c("trend_evidence"), S.growth_factor(c("demand_growth"))).otherwise(0.5),
        "imbalance": F.when(c("trend_evidence"), S.growth_factor(c("demand_supply"))).otherwise(0.5),
        "repeat": c("repeatability"),
        "fresh": S.clamp(1 - c("age_minutes") / (24.0 * 60)),
        "price": S.price_factor(c("price_eur"), c("market_median")),
    }
    raw = sum((WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))
    evidence = F.when(c("market_count") > 0, c("market_count")).otherwise(c("peers"))
    least = lambda most, x: F.least(F.lit(most), x)
    confidence = (
        34.0 + least(18.0, F.greatest(F.lit(0), c("peers") - 1) * 2.5) + least(18.0, F.sqrt(evidence) * 2.6) + least(14.0, c("history_samples") * 1.4)
        + least(8.0, c("market_prior_signals") * 1.2) + F.when(c("cohort_key") != "", 3.0).otherwise(0.0) + least(2.0, F.coalesce("identity_confidence", F.lit(0)) * 0.02)
    )
    rows = rows.withColumns({"score": S.half_even(S.clamp(raw, 0.0, 100.0)).cast("int"), "confidence": S.half_even(S.clamp(confidence, 22.0, 97.0)).cast("int"), "price_delta_pct": 100 * S.price_delta(c("price_eur"), c("market_median"))})
    rows = rows.withColumns({
        "stage": S.stage(c("score")),
        "opportunity_type": S.opportunity_type(c("score"), c("saturation"), c("anomaly_ratio"), c("demand_growth"), c("demand_supply"), c("repeatability"), c("trend_evidence")),
        "_u": S.clamp(0.44 - 0.0027 * c("confidence"), 0.16, 0.38),
    })
    for hours, keep in ((3, 0.92), (6, 0.84)):
        at = lambda sign, hours=hours, keep=keep: S.half_even(c("views") + c("vph") * hours * keep * (1 + sign * c("_u"))).cast("int")
        rows = rows.withColumn(f"predicted_{hours}h_low", F.greatest(c("views"), at(-1)))
        rows = rows.withColumn(f"predicted_{hours}h_high", F.greatest(c(f"predicted_{hours}h_low"), at(1)))
    return rows.withColumn("reasons", reasons()).drop("_u", "_now", "_grown", "_q50", "_q85", "_q90", "c0", "c1", "c2")


def reasons() -> Column:
    """Why a row scores as it does, as codes with their numbers."""
    c = F.col
    said = [
        c("opportunity_type"),
        F.when(c("vs_history").isNotNull(), F.format_string("family rate %.2fx its own history", c("vs_history")))
        .when(c("category_ratio") >= 1.5, F.format_string("rate %.1fx the category's median", c("category_ratio")))
        .otherwise("no own history yet"),
        F.when(c("trend_evidence"), F.format_string("demand %.2fx, demand to supply %.2fx", c("demand_growth"), c("demand_supply"))).otherwise("trend unknown, neutral"),
        F.when(c("market_count") > 0, F.format_string("market of %d, saturation %d", c("market_count"), c("saturation"))).otherwise("family new, saturation unknown"),
        F.when(c("peers") >= 2, F.format_string("repeats in %.0f%% of %d", c("repeatability") * 100, c("peers"))),
        F.when(c("supply_growth") >= 1.15, F.format_string("supply grows %.2fx", c("supply_growth"))).when((c("supply_growth") <= 0.85) & (c("market_count") > 0), F.format_string("supply lags %.2fx", c("supply_growth"))),
        F.when(c("price_delta_pct") >= 8, F.format_string("%.0f%% below the median", c("price_delta_pct"))).when(c("price_delta_pct") <= -10, F.format_string("%.0f%% above the median", -c("price_delta_pct"))),
    ]
    return F.array_compact(F.array(*said))


def shortlist(scores: DataFrame, floor: int = 65, per_category: int = 10, total: int = 20, controls: int = 2, per_cohort: int = 2) -> DataFrame:
    """The best of each category, at most per_cohort of one cohort, then the best of all; and controls below the floor.

    Two ranks give the greedy choice: first within the cohort, then in the category among those that are left.
    """
    best = [F.desc("score"), F.desc("repeatability"), F.desc("velocity_percentile"), F.asc("external_id")]
    able = scores.filter((F.col("score") >= floor) & ~((F.col("opportunity_type") == "saturated") & (F.col("score") < 90)))
    cohort = F.when(F.col("cohort_key") != "", F.col("cohort_key")).otherwise(F.concat(F.lit("single:"), F.col("external_id")))
    diverse = able.withColumn("_c", F.row_number().over(Window.partitionBy("category", cohort).orderBy(*best))).filter(F.col("_c") <= per_cohort)
    visible = diverse.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(*best))).filter(F.col("_r") <= per_category)
    visible = visible.orderBy(F.desc("score"), "category", "_r").limit(total).drop("_c", "_r").withColumn("is_control", F.lit(False))
    low = scores.filter(F.col("score") < floor).withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(*best))).filter(F.col("_r") <= controls)
    return visible.unionByName(low.drop("_r").withColumn("is_control", F.lit(True)))


def without_recent(selected: DataFrame, tracked: DataFrame) -> DataFrame:
    """Visible candidates that aren't tracked already; controls stay."""
    known = tracked.filter(~F.col("is_control")).select("external_id").distinct()
    return selected.filter("NOT is_control").join(known, "external_id", "left_anti").unionByName(selected.filter("is_control"))


def dynamic_score(m: DataFrame) -> DataFrame:
    """Q13: measurements (initial_score, initial_vph, baseline_views, views, elapsed_hours, peer_median, peer_p85, target_hours, previous_views, previous_elapsed) with their new score and outcome."""
    c = F.col
    elapsed = F.greatest(F.lit(0.25), c("elapsed_hours"))
    delta = F.greatest(F.lit(0), c("views") - c("baseline_views"))
    m = m.withColumns({"gain": delta, "observed_vph": delta / elapsed})
    interval = F.greatest(F.lit(0.10), elapsed - F.greatest(F.lit(0.0), c("previous_elapsed")))
    recent = F.when(c("previous_views").isNotNull() & c("previous_elapsed").isNotNull(), F.greatest(F.lit(0), c("views") - c("previous_views")) / interval).otherwise(c("observed_vph"))
    strength = S.clamp((c("observed_vph") - c("peer_median")) / F.greatest(F.lit(1.0), c("peer_p85") - c("peer_median")))
    m = m.withColumns({"recent_vph": recent, "strength": strength})
    momentum = F.when(c("initial_vph") <= 0, F.when(c("recent_vph") > 0, 1.0).otherwise(0.0)).otherwise(c("recent_vph") / F.greatest(F.lit(0.5), c("initial_vph")))
    m = m.withColumn("momentum", momentum)
    raw = c("initial_score") * 0.45 + c("strength") * 37.0 + S.clamp(c("momentum") - 0.5) * 18.0
    m = m.withColumn("score", S.half_even(S.clamp(raw, 0.0, 100.0)).cast("int")).withColumn("stage", S.stage(c("score")))
    strong = F.greatest(F.lit(2.0), c("peer_p85"))
    sure = (c("target_hours") >= 3) & (c("gain") >= 10) & (c("observed_vph") >= strong * 1.15) & (c("score") >= 88)
    held = (c("gain") >= 10) & (c("observed_vph") >= strong) & (c("score") >= 84)
    return m.withColumn("outcome", F.when(sure, "confirmed").when(c("target_hours") >= 6, F.when(held, "confirmed").otherwise("rejected")).otherwise("pending"))


def reclassified(score: Column, sat: Column, momentum: Column, repeatability: Column, demand_supply: Column, before: Column) -> Column:
    """Q14: the type as evidence comes in; thresholds are its own. A strong type stays where nothing else holds."""
    return (
        F.when((score >= 82) & (sat >= 65) & (momentum >= 1.15), "hot_product")
        .when((score >= 84) & (sat <= 45) & (repeatability >= 0.42), "hidden_gem")
        .when((score >= 82) & (demand_supply >= 1.12) & (momentum >= 1.08), "emerging")
        .when((sat >= 70) & (momentum < 1.05), "saturated")
        .when(before.isin("hidden_gem", "hot_product", "emerging"), before)
        .otherwise("spark")
    )


def forecast_accuracy(candidates: DataFrame, width: int = 10) -> DataFrame:
    """By score band how many resolved candidates were confirmed."""
    done = candidates.filter(F.col("outcome").isin("confirmed", "rejected")).withColumn("band", (F.floor(F.col("score") / width) * width).cast("int"))
    return done.groupBy("band").agg(F.count(F.lit(1)).alias("resolved"), F.count_if(F.col("outcome") == "confirmed").alias("confirmed")).withColumn("hit_rate", F.col("confirmed") / F.col("resolved"))
