"""Opportunity scores of pinned cases: what is hot, saturated, rare, confirmed and rejected."""

import pytest
from pyspark.sql import functions as F

from stallmetrics.functions import stats
from stallmetrics.operators import market, observations, scoring

_PROFILE = "family_key string, count long, median double, supply_percentile double, recent_count long, previous_count long, supply_growth_ratio double, demand_recent_median double, demand_previous_median double, demand_growth_ratio double, demand_recent_samples long, demand_previous_samples long, prior_signals long, prior_confirmed long"
_FEATURES = "external_id string, category_key string, identity_key string, identity_confidence int, price_eur int, views int, age_minutes double, cohort_key string"


def _profile(spark, rows):
    made = [(k, 500, 600.0, 0.96, 0, 0, growth, recent, before, None, n, n, prior, good) for k, growth, recent, before, n, prior, good in rows]
    return spark.createDataFrame(made, _PROFILE).select("family_key", *market.PROFILE)


def _scored(spark, others, profiles):
    phones = [(f"i{i}", "cat", "iphone", 95, 600, v, 120.0, "id:iphone") for i, v in enumerate([180, 170, 160, 150, 140, 130, 120, 110])]
    rest = [(f"o{i}", "cat", None, 0, 100, v, 120.0, f"fam:cat:other|model{i}") for i, v in enumerate(others)]
    return {r.external_id: r for r in scoring.initial_scores(spark.createDataFrame(phones + rest, _FEATURES), profiles).collect()}


def test_a_popular_family_that_moves_is_hot(spark):
    found = _scored(spark, [10, 12, 15, 18, 20, 25, 30, 35], _profile(spark, [("id:iphone", 1.05, 70.0, 45.0, 10, 8, 5)]))["i0"]
    assert found.saturation >= 90 and found.opportunity_type == "hot_product" and found.score >= 80
    assert found.reasons[0] == "hot_product" and any("its own history" in r for r in found.reasons) and any("market of 500" in r for r in found.reasons)
    assert found.views <= found.predicted_3h_low <= found.predicted_3h_high <= found.predicted_6h_high and 22 <= found.confidence <= 97


def test_a_popular_family_that_stands_still_is_saturated(spark):
    found = _scored(spark, [20 + i for i in range(8)], _profile(spark, [("id:iphone", 1.0, 80.0, 80.0, 10, 0, 0)]))["i0"]
    assert found.opportunity_type == "saturated" and found.score < 80


def test_rare_is_no_winner_and_no_market_is_neutral(spark):
    rows = [("rare", "cat", None, 0, 100, 3, 120.0, "fam:cat:rare|zx991"), *[(f"n{i}", "cat", None, 0, 100, v, 120.0, f"fam:cat:normal|a{i}") for i, v in enumerate([30, 25, 20])]]
    found = scoring.initial_scores(spark.createDataFrame(rows, _FEATURES), _profile(spark, [("none", 1.0, 1.0, 1.0, 0, 0, 0)])).filter("external_id = 'rare'").first()
    assert found.score < 65 and found.price_delta_pct is None and "family new, saturation unknown" in found.reasons


@pytest.mark.parametrize(("initial", "base", "views", "hours", "outcome"), [(91, 40, 220, 3, "confirmed"), (82, 50, 70, 6, "rejected")])
def test_outcomes(spark, initial, base, views, hours, outcome):
    row = (initial, 30.0, base, views, float(hours), 10.0, 25.0, hours, None, None)
    m = spark.createDataFrame([row], "initial_score int, initial_vph double, baseline_views int, views int, elapsed_hours double, peer_median double, peer_p85 double, target_hours int, previous_views int, previous_elapsed double")
    found = scoring.dynamic_score(m).first()
    assert found.outcome == outcome and (outcome == "rejected" or found.score >= 88)


def test_retried_attempts(spark):
    rows = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (2, 3, "2024-01-01 00:00:00")], "id int, attempts int, due string").withColumn("due_at", F.col("due").cast("timestamp"))
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert [(r.status, str(r.due_at)) for r in observations.retried(rows, at).orderBy("id").collect()] == [("pending", "2024-01-02 00:15:00"), ("error", "2024-01-01 00:00:00")]


def test_moving_average_of_times_far_apart(spark):
    """The order's values are microseconds of days; runs are of places, not of values."""
    rows = [("a", 86_400_000_000 * i, float(i % 7)) for i in range(9000)] + [("b", 5, 3.0), (None, 1, 2.0), (None, 2, 4.0)]
    want = {}
    for k, _, v in rows:
        want[k] = v if k not in want else 0.75 * want[k] + 0.25 * v
    found = stats.ema(spark.createDataFrame(rows, "k string, at long, v double").repartition(5), ["k"], "at", "v", 0.25, "e")
    assert {r.k: round(r.e, 9) for r in found.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_medians_without_a_row_read_no_other_row(spark):
    """By brute force; rows are joined to their partition's middle alone, not to each of its values."""
    import random
    from statistics import median

    rng, rows = random.Random(3), [("a", 7)]
    for key, n, most in (("b", 2, 9), ("c", 3, 9), ("d", 40, 5), ("e", 41, 1000), ("f", 200, 30)):
        rows += [(key, rng.randrange(1, most)) for _ in range(n)]
    rows = [(i, k, v) for i, (k, v) in enumerate(rows)]
    found = stats.leave_one_out_median(spark.createDataFrame([*rows, (-1, "b", None)], "id int, k string, v int"), "v", ["k"], "m", "n")
    want = {i: (int(median(o)) if (o := [w for j, g, w in rows if g == k and j != i]) else None, len(o) + 1) for i, k, _ in rows}
    assert {r.id: (r.m, r.n) for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_profiles_are_looked_up_once_for_each_list_of_keys(spark):
    """Rows aren't multiplied by their keys and gathered again: rows of one id stay apart, and each takes its first key with a profile."""
    profiles = _profile(spark, [("x", 1.0, 70.0, 45.0, 1, 8, 5), ("y", 2.0, 70.0, 45.0, 2, 8, 5)])
    rows = spark.createDataFrame([("a", None, "x"), ("a", "none", "y"), ("b", "y", "x"), ("c", None, None)], "external_id string, one string, two string")
    found = market.lookup(rows, profiles, [F.col("one"), F.col("two")])
    assert sorted((r.external_id, r.market_count, r.market_supply_growth_ratio) for r in found.collect()) == [("a", 500, 1.0), ("a", 500, 2.0), ("b", 500, 2.0), ("c", 0, 1.0)]
