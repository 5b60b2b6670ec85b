"""Result modes (survey Q3-Q9, N3-N4, A6-A7, S27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import half_even, int_median, leave_one_out_median
from ..functions.timeparse import micros, minutes_between
from ..shared import newest


def frequent(rows: DataFrame, least: int = 3) -> DataFrame:
    """Q3: families with enough distinct ads: counts, prices, the newest example. An id that comes again counts with its last row."""
    one = newest(rows.filter("family_key <> ''"), ["category", "family_key", "external_id"], [F.desc_nulls_last("ordinal")])
    price = F.when(F.col("price_eur") > 0, F.col("price_eur"))
    found = one.groupBy("category", "family_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(price).alias("min_price"),
        int_median(price).alias("median_price"),
        F.max(price).alias("max_price"),
        F.min_by("family_confidence", "ordinal").alias("confidence"),
        F.max_by(F.struct("title", "external_id"), F.struct("posted_at", -F.col("ordinal"))).alias("newest"),
    )
    return found.filter(F.col("n") >= least).select("category", "family_key", "n", "min_price", "median_price", "max_price", "confidence", F.col("newest.title").alias("example_title"), F.col("newest.external_id").alias("example_id"))


def below_market(rows: DataFrame, discount: float = 0.20, samples: int = 5) -> DataFrame:
    """Q4: ads at least that far below the median of the others of their family; placeholder prices and small families don't count."""
    priced = rows.filter("family_key <> '' AND price_eur > 0")
    measured = leave_one_out_median(priced, "price_eur", ["category", "family_key"], "median_price", "samples").filter(F.col("samples") >= samples)
    bait = (F.col("median_price") >= 50) & (F.col("price_eur") < F.greatest(F.lit(5), F.floor(F.col("median_price") * 0.10)))
    off = 1 - F.col("price_eur") / F.col("median_price")
    return measured.filter((F.col("median_price") > 0) & ~bait & (off >= discount)).withColumn("discount_pct", half_even(off * 100).cast("int"))


def fast_disappearing(rows: DataFrame, hours: float = 12) -> DataFrame:
    """Q5: ads gone within so many hours of being first seen; rank 0 to 2 by how soon after the last sighting that was noticed."""
    lived = minutes_between(F.col("first_seen_at"), F.col("disappeared_at"))
    gap = minutes_between(F.coalesce("last_seen_at", "first_seen_at"), F.col("disappeared_at"))
    found = rows.filter("disappeared_at IS NOT NULL").withColumns({"lifespan_minutes": lived, "gap_minutes": gap}).filter(F.col("lifespan_minutes") <= hours * 60)
    rank = F.when(F.col("gap_minutes") <= 30, 0).when(F.col("gap_minutes") <= 120, 1).otherwise(2)
    return found.withColumn("rank", rank).withColumn("confidence", F.element_at(F.array(*map(F.lit, ("высокая", "средняя", "низкая"))), F.col("rank") + 1))


def last_two_prices(history: DataFrame) -> DataFrame:
    """external_id with the last two different prices in a row: previous_price, current_price, changed_at."""
    by_time = Window.partitionBy("external_id").orderBy("recorded_at", "id")
    before = F.lag("price_eur").over(by_time)
    runs = history.filter("price_eur > 0").withColumn("previous_price", before).filter(F.col("previous_price").isNull() | (F.col("previous_price") != F.col("price_eur")))
    last = runs.groupBy("external_id").agg(F.max_by(F.struct("previous_price", F.col("price_eur").alias("current_price"), F.col("recorded_at").alias("changed_at")), F.struct("recorded_at", "id")).alias("_last"))
    return last.select("external_id", "_last.*").filter("previous_price IS NOT NULL")


def price_drops(rows: DataFrame, history: DataFrame, pct: int = 5, eur: int = 5) -> DataFrame:
    """Q6: known ads whose last change of price is a fall of enough percent and euros."""
    drop = F.col("previous_price") - F.col("current_price")
    found = last_two_prices(history).withColumn("drop_eur", drop).filter(F.col("drop_eur") >= F.greatest(F.lit(eur), F.lit(1)))
    found = found.withColumn("drop_pct", half_even(F.col("drop_eur") / F.col("previous_price") * 100).cast("int")).filter(F.col("drop_pct") >= pct)
    return rows.join(found, "external_id")


def latest_scans(scans: DataFrame) -> DataFrame:
    """The last scan of each category that was done."""
    return scans.filter("status = 'done'").groupBy("category").agg(F.max_by("scan_id", F.struct("finished_at", "scan_id")).alias("scan_id"))


def most_viewed(scans: DataFrame, snapshots: DataFrame, top: int = 12) -> DataFrame:
    """Q7: the most viewed ads of each category's latest scan, place 1 to top."""
    seen = snapshots.filter("view_count IS NOT NULL").join(latest_scans(scans), "scan_id")
    order = Window.partitionBy("category").orderBy(F.desc("view_count"), "external_id")
    return seen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def growth(snapshots: DataFrame, history: DataFrame, target_hours: int, top: int = 12) -> DataFrame:
    """Q8: in each scan the ads that gained most views from its capture to the checkpoint; also views per hour over the real interval."""
    later = history.filter(F.col("target_hours") == target_hours).groupBy("scan_id", "external_id").agg(F.max_by(F.struct(F.col("view_count").alias("later_views"), "recorded_at"), "recorded_at").alias("_l"))
    both = snapshots.filter("view_count IS NOT NULL").join(later, ["scan_id", "external_id"]).select("*", "_l.*").drop("_l")
    hours = (micros("recorded_at") - micros("captured_at")) / 3.6e9
    gained = both.withColumn("gain", F.col("later_views") - F.col("view_count")).filter("gain > 0").withColumn("per_hour", F.col("gain") / F.greatest(hours, F.lit(0.25)))
    order = Window.partitionBy("scan_id").orderBy(F.desc("gain"), "external_id")
    return gained.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def refresh_summary(measured: DataFrame, by: list[str]) -> DataFrame:
    """Q9: of a refresh (before, after, reused): fresh, reused and missing values, and growth."""
    gain = F.greatest(F.col("after") - F.col("before"), F.lit(0))
    known = F.col("after").isNotNull()
    return measured.groupBy(*by).agg(
        F.count_if(known & ~F.col("reused")).alias("fresh"),
        F.count_if(known & F.col("reused")).alias("reused_values"),
        F.count_if(~known).alias("no_data"),
        F.count_if(gain > 0).alias("increased"),
        F.coalesce(F.max(gain), F.lit(0)).alias("max_growth"),
        F.coalesce(F.sum(gain), F.lit(0)).alias("total_growth"),
    )


def first_known(df: DataFrame, phases: list[str], out: str) -> DataFrame:
    """The first phase that has a value, and its name as the source."""
    source: Column = F.lit(None).cast("string")
    for p in reversed(phases):
        source = F.when(F.col(p).isNotNull(), p).otherwise(source)
    return df.withColumns({out: F.coalesce(*phases), f"{out}_source": source})
