"""Statistics and scoring factors as columns (survey A2-A5, A17, N1-N2, M1-M13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import numbered, stored


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """M1. Of null it is a limit, not null: greatest and least pass nulls over."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounds halves to even digits."""
    return F.bround(x, digits)


def percentile(x: Column, q: float) -> Column:
    """A3: linear interpolation between order statistics; nothing to measure is 0."""
    return F.coalesce(F.percentile(F.when(~F.isnan(x), x), F.lit(q)), F.lit(0.0))


def percentiles(x: Column, of: dict[str, float]) -> list[Column]:
    """A3: several of the same values, by name; equal aggregates are one, so the values are counted once."""
    all_ = F.percentile(F.when(~F.isnan(x), x), F.array(*map(F.lit, of.values())))
    return [F.coalesce(F.get(all_, F.lit(i)), F.lit(0.0)).alias(name) for i, name in enumerate(of)]


def int_median(x: Column) -> Column:
    """A2: the median with its fraction cut off; null if there is nothing."""
    return F.floor(F.percentile(x, F.lit(0.5))).cast("int")


def mid_rank(df: DataFrame, value: str, by: list[str], out: str, alone: float = 0.5) -> DataFrame:
    """(values below + half of the equal ones) / all, in the partition; a single value ranks `alone`.

    Counts per distinct value are summed over a window, so a partition's window has its distinct values only.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(*by))).withColumn(
        out, F.when(F.col("_all") <= 1, F.lit(alone)).otherwise((F.coalesce(F.sum("_n").over(below), F.lit(0)) + 0.5 * F.col("_n")) / F.col("_all"))
    )
    # Written, so that its size is known and it is broadcast where it is small.
    ranked = stored(ranked.select(*[F.col(c).alias(f"_{c}") for c in (*by, value)], out), "ranks")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, value)]
    return df.join(ranked, on).select(*df.columns, out)


def mid_rank_among(values: DataFrame, value: str, others: DataFrame, other: str, by: list[str], out: str) -> DataFrame:
    """N1 against a different list: rank of each distinct value of `values` among `others` of its partition."""
    ours = values.select(*by, F.col(value).alias("_v")).distinct().select(*by, "_v", F.lit(0).alias("_w"), F.lit(True).alias("_ours"))
    theirs = others.groupBy(*by, F.col(other).alias("_v")).agg(F.count(F.lit(1)).alias("_w")).withColumn("_ours", F.lit(False))
    every = ours.unionByName(theirs).groupBy(*by, "_v").agg(F.sum("_w").alias("_w"), F.max("_ours").alias("_ours"))
    w = Window.partitionBy(*by).orderBy("_v")
    every = every.withColumn("_all", F.sum("_w").over(Window.partitionBy(*by))).withColumn("_below", F.coalesce(F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.when(F.col("_all") <= 1, F.lit(0.5)).otherwise((F.col("_below") + 0.5 * F.col("_w")) / F.col("_all"))
    ranked = stored(every.filter("_ours").select(*[F.col(c).alias(f"_{c}") for c in by], "_v", rank.alias(out)), "ranks")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return values.join(ranked, [*on, F.col(value).eqNullSafe(F.col("_v"))]).select(*values.columns, out)


def leave_one_out_median(df: DataFrame, value: str, by: list[str], out: str, n: str | None = None) -> DataFrame:
    """A5: for each row the median of the other rows' values in its partition, its fraction cut off; null for a single row. n: a column for the number of values.

    The order statistics around the middle give it: without one row of value v, place k of the rest is place k + 1 of all
    where that has more than v, else place k. So rows are joined to four values of their partition and to nothing else.
    Rows of one id have to be one row.
    """
    # Distinct values with their counts take the places start to end; a hot partition has as many rows as it has values.
    up = Window.partitionBy(*by).orderBy(value)
    values = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    values = values.withColumn("_end", F.sum("_c").over(up)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    near = values.filter((F.col("_end") - F.col("_c") + 1 <= F.col("_n") / 2 + 2) & (F.col("_end") >= F.col("_n") / 2 - 1))
    middle = near.groupBy(*by, "_n").agg(F.sort_array(F.collect_list(F.struct("_end", F.col(value).alias("_v")))).alias("_at"))
    at = lambda k: F.get(F.filter("_at", lambda x: x["_end"] >= k), F.lit(0))["_v"]
    low, high = F.floor(F.col("_n") / 2), F.floor((F.col("_n") + 1) / 2)
    # Written, so that its size is known and it is broadcast where it is small.
    middle = stored(middle.select(*by, "_n", at(low).alias("_a"), at(low + 1).alias("_b"), at(high).alias("_c"), at(high + 1).alias("_d")), "middles")
    without = lambda k, above: F.when(F.col(value) < F.col(above), F.col(above)).otherwise(F.col(k)).cast("double")
    placed = df.filter(F.col(value).isNotNull()).join(middle, by)
    found = placed.withColumn(out, F.when(F.col("_n") > 1, F.floor((without("_a", "_b") + without("_c", "_d")) / 2)).cast("int"))
    return found.select(*df.columns, out, *([F.col("_n").alias(n)] if n else []))


#: Values of a series that are folded in one row.
BLOCK = 4096


def ema(df: DataFrame, by: list[str], order: str, value: str, alpha: float, out: str) -> DataFrame:
    """The last exponential moving average of each series; its first value seeds it. order: any column; equal ones go by value.

    A step is the map x -> (1 - alpha) x + alpha value, and such maps compose. So runs of BLOCK places in the order, then
    runs of those, are each folded to one map; a key's rows never stand in one list, however far apart its order's values
    are. Applied to the first value, the first step changes nothing.
    """
    one = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))

    def folded(maps: Column) -> Column:
        return F.aggregate(F.array_sort(maps), one, lambda a, x: F.struct((a["w"] * x["w"]).alias("w"), (a["s"] * x["w"] + x["s"]).alias("s")))

    rows = numbered(df.select(*by, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")), [*by, "_o", "_v"], "_at")
    step = F.struct(F.col("_at").alias("at"), F.lit(1 - alpha).alias("w"), (F.col("_v") * alpha).alias("s"))
    level = rows.select(*by, "_at", step.alias("_map"), F.struct(F.col("_at").alias("at"), F.col("_v").alias("v")).alias("_first"))
    for _ in range(2):
        level = level.groupBy(*by, F.floor(F.col("_at") / BLOCK).alias("_at")).agg(folded(F.collect_list("_map")).alias("_m"), F.array_min(F.collect_list("_first")).alias("_first"))
        level = level.select(*by, "_at", F.struct(F.col("_at").alias("at"), "_m.w", "_m.s").alias("_map"), "_first")
    last = level.groupBy(*by).agg(folded(F.collect_list("_map")).alias("_m"), F.array_min(F.collect_list("_first")).alias("_first"))
    return last.select(*by, (F.col("_m.w") * F.col("_first.v") + F.col("_m.s")).alias(out))


# Scoring factors


def views_per_hour(views: Column, age_minutes: Column) -> Column:
    """M2."""
    return views / F.greatest(F.lit(0.25), age_minutes / 60)


def price_delta(price: Column, median: Column) -> Column:
    """Share below the median; null without a market."""
    return F.when(price.isNotNull() & (median > 0), (median - price) / median)


def price_factor(price: Column, median: Column) -> Column:
    """M3: neutral without a market."""
    delta = price_delta(price, median)
    return F.when(delta.isNull(), 0.5).otherwise(clamp(0.5 + 2.5 * delta))


def ratio_factor(r: Column) -> Column:
    """M4."""
    return clamp((F.log2(F.greatest(F.lit(0.05), r)) + 1) / 3)


def growth_factor(r: Column) -> Column:
    """M5."""
    return clamp(0.5 + F.log2(clamp(F.when(r != 0, r).otherwise(1.0), 0.2, 5.0)) / 2)


def demand_factor(views: Column, vph: Column) -> Column:
    """M6."""
    part = lambda x, full: clamp(F.log1p(F.greatest(F.lit(0.0), x)) / F.log1p(F.lit(full)))
    return 0.72 * part(vph, 30.0) + 0.28 * part(views.cast("double"), 120.0)


def saturation(percentile_: Column, share: Column, count: Column) -> Column:
    """M7."""
    score = half_even(100 * clamp(0.86 * clamp(percentile_) + 0.14 * clamp(share / 0.25)))
    return F.when(count <= 0, 0).otherwise(score).cast("int")


def combined_growth(a: Column, b: Column) -> Column:
    """M8: geometric mean of the positive ratios, clipped; null without evidence."""
    known = lambda x: F.when(x > 0, F.log(clamp(x, 0.2, 5.0)))
    la, lb = known(a), known(b)
    n = la.isNotNull().cast("int") + lb.isNotNull().cast("int")
    return F.when(n > 0, clamp(F.exp((F.coalesce(la, F.lit(0.0)) + F.coalesce(lb, F.lit(0.0))) / n), 0.2, 5.0))


def stage(score: Column) -> Column:
    """M10."""
    return F.when(score >= 90, "early_winner").when(score >= 80, "rising").otherwise("watch")


def opportunity_type(score: Column, sat: Column, anomaly: Column, growth: Column, demand_supply: Column, repeat: Column, evidence: Column) -> Column:
    """M9: first rung that holds."""
    moves = F.greatest(growth, demand_supply)
    return (
        F.when((score >= 80) & (sat >= 65) & evidence & (moves >= 1.18), "hot_product")
        .when((score >= 80) & (sat <= 45) & (anomaly >= 1.45) & (repeat >= 0.42), "hidden_gem")
        .when((score >= 80) & evidence & (demand_supply >= 1.12) & (moves >= 1.18), "emerging")
        .when((sat >= 70) & (~evidence | (moves < 1.12)), "saturated")
        .otherwise("spark")
    )
