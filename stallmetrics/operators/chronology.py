"""Page chronology and the page where a day begins (survey Q18-Q19, A14, N9-N17, J13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, half_even
from ..shared import stored

# Pages to probe first by the age of a day.
COLD_PAGES = {0: (1, 2, 4, 7, 11, 17, 26, 38, 50), 1: (1, 3, 6, 10, 15, 22, 31, 40, 50), 2: (1, 4, 8, 13, 19, 26, 34, 42, 50), 3: (1, 6, 11, 17, 24, 31, 38, 44, 50), 4: (1, 7, 14, 21, 28, 35, 41, 46, 50)}
ENOUGH_DATED, DOMINANCE, LAST_PAGE = 2, 0.70, 50


def page_profile(items: DataFrame, target: Column, by: list[str], pages: DataFrame | None = None) -> DataFrame:
    """Q18: for each page the relation of its items' days (column day, null: none) to a target day, with counts and a confidence.

    pages: all pages that were read; one of them without items is empty.
    """
    day = F.col("day")
    counts = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.count(day).alias("dated"), F.count_if(day == target).alias("target_count"), F.count_if(day > target).alias("newer"), F.count_if(day < target).alias("older")
    )
    if pages is not None:
        counts = pages.select(*by).distinct().join(counts, by, "left").na.fill(0, ["items", "dated", "target_count", "newer", "older"])
    c = F.col
    coverage = F.when(c("items") > 0, c("dated") / c("items")).otherwise(0.0)
    turned = F.greatest("newer", "older") / (c("newer") + c("older"))
    enough = c("dated") >= F.least(F.lit(ENOUGH_DATED), c("items"))
    relation = (
        F.when(c("items") == 0, "empty").when(c("dated") == 0, "unknown").when(c("target_count") > 0, "target").when(~enough, "unknown").when(c("older") == 0, "newer").when(c("newer") == 0, "older")
        .when(turned >= DOMINANCE, F.when(c("newer") > c("older"), "newer").otherwise("older")).otherwise("mixed")
    )
    out = counts.withColumn("coverage", coverage).withColumn("relation", relation)
    one_way = (c("newer") == 0) | (c("older") == 0)
    confidence = (
        F.when(c("dated") == 0, 0.0)
        .when(c("target_count") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.35), c("coverage"), c("target_count") / c("dated"))))
        .when(~enough, F.greatest(F.lit(0.1), c("coverage") * 0.5))
        .when(one_way, F.greatest(F.lit(0.35), c("coverage")))
        .when(turned >= DOMINANCE, F.greatest(F.lit(0.30), c("coverage") * turned))
        .otherwise(F.greatest(F.lit(0.25), c("coverage") * turned))
    )
    return out.withColumn("confidence", confidence)


def boundary(pages: DataFrame, by: list[str]) -> DataFrame:
    """N14-N15, of pages with their relation: low (the last newer page), high (the first that isn't), and where to go on. One pass over all pages."""
    c = F.col
    is_ = lambda *r: c("relation").isin(*r)
    first = pages.groupBy(*by).agg(
        F.min(F.when(is_("target"), c("page"))).alias("target"),
        F.max(F.when(is_("newer"), c("page"))).alias("last_newer"),
        F.max(F.when((c("page") == 1) & is_("older", "mixed", "empty"), True)).alias("at_once"),
        F.count_if(is_("older", "mixed", "empty")).alias("not_newer"),
        F.sort_array(F.collect_set(F.when(is_("newer"), c("page")))).alias("newer_pages"),
        F.sort_array(F.collect_set(F.when(is_("target", "older", "mixed", "empty"), c("page")))).alias("other_pages"),
    )
    below_target = F.coalesce(F.array_max(F.filter("newer_pages", lambda p: p < c("target"))), F.lit(0))
    above = F.array_min(F.filter("other_pages", lambda p: p > c("last_newer")))
    low = F.when(c("target").isNotNull(), below_target).when(c("at_once"), 0).when(above.isNotNull(), c("last_newer"))
    high = F.when(c("target").isNotNull(), c("target")).when(c("at_once"), 1).otherwise(above)
    newer = c("last_newer").isNotNull()
    onward = F.when(c("target").isNotNull(), "done").when(newer & (c("not_newer") == 0), "right").when(~newer & (c("not_newer") > 0), "left").otherwise("both")
    return first.select(*by, low.cast("int").alias("low"), high.cast("int").alias("high"), onward.alias("direction"))


def predicted_page(points: DataFrame, targets: DataFrame, by: list[str], reach: int = 6, own: bool = True) -> DataFrame:
    """The page of a target day from confirmed (day, page) points within reach days: its own, else on the line through the two nearest.

    A target asks for each day within reach, so the range is an equality join. own: whether the day's own point counts.
    """
    confirmed = points.groupBy(*by, "day").agg(F.max_by("page", "confirmed_at").alias("page"))
    asked = F.explode(F.array(*[F.date_add("target", k) for k in range(-reach, reach + 1) if k or own]))
    near = targets.select(*by, "target", asked.alias("day")).join(confirmed, [*by, "day"])
    order = Window.partitionBy(*by, "target").orderBy(F.abs(F.datediff("day", "target")), "day")
    two = near.withColumn("_i", F.row_number().over(order)).filter("_i <= 2")
    line = two.groupBy(*by, "target").agg(F.min(F.struct("day", "page")).alias("a"), F.max(F.struct("day", "page")).alias("b"), F.max(F.when(F.col("day") == F.col("target"), F.col("page"))).alias("exact"))
    slope = (F.col("b.page") - F.col("a.page")) / F.nullif(F.datediff("b.day", "a.day"), F.lit(0))
    at = clamp(half_even(F.col("a.page") + slope * F.datediff("target", "a.day")), 1, LAST_PAGE)
    fits = (slope < -0.25) & (slope >= -50.0)
    source = F.when(F.col("exact").isNotNull(), "exact").when(fits, F.when(F.col("target").between(F.col("a.day"), F.col("b.day")), "interpolated").otherwise("extrapolated"))
    page = F.when(F.col("exact").isNotNull(), clamp(F.col("exact"), 1, LAST_PAGE)).when(fits, at)
    return line.select(*by, "target", page.cast("int").alias("page"), source.alias("source")).filter("page IS NOT NULL")


def cold_pages(age_days: int) -> tuple[int, ...]:
    """N16."""
    return COLD_PAGES.get(max(0, age_days), (1, 9, 17, 25, 33, 41, LAST_PAGE))


def prefetch_range(current: Column, last: Column, limit: Column, window: int = 10, low_water: int = 4) -> Column:
    """Struct of the next pages to fetch, or null while enough are under way."""
    current, last, limit = F.greatest(F.lit(1), current), F.greatest(F.lit(0), last), F.greatest(F.lit(1), limit)
    start, end = F.greatest(current + 1, last + 1), F.least(limit, current + window)
    warm = (last > current) & (last - current > low_water)
    return F.when((current < limit) & ~warm & (start <= end), F.struct(start.alias("start"), end.alias("end")))


def shards(df: DataFrame, order: list[str], n: int, by: list[str]) -> DataFrame:
    """Rows of each job dealt to n shards in turn."""
    return df.withColumn("shard", F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1, F.lit(n)))


def fair_round(queue: DataFrame, job: str, order: list[str], target: int) -> DataFrame:
    """The first `target` rows if jobs take turns; place is their order."""
    turn = F.row_number().over(Window.partitionBy(job).orderBy(*order))
    return queue.withColumn("turn", turn).filter(F.col("turn") <= target).orderBy("turn", job).limit(target)


def refined_boundary(profile: DataFrame, probes: DataFrame, by: list[str], rounds: int = 2, stop: int = 3) -> DataFrame:
    """The boundary by what was probed (by, page), narrowed at the quarters of a wide bracket, round by round, by what the pages there say.

    profile: the relation of each page that can be asked. A bracket of `stop` pages or fewer is narrow enough. Gives by, low, high, direction, probed.
    """
    c = F.col
    seen = stored(profile.join(probes.select(*by, "page").distinct(), [*by, "page"]), "probed")
    for _ in range(rounds):
        wide = boundary(seen, by).filter(c("high") - c("low") > stop)
        width = c("high") - c("low")
        quarters = F.array(*[F.greatest(c("low") + 1, F.least(c("high") - 1, c("low") + F.bround(width * r).cast("int"))) for r in (0.25, 0.5, 0.75)])
        asked = wide.select(*by, F.explode(F.array_distinct(quarters)).alias("page")).join(seen.select(*by, "page"), [*by, "page"], "left_anti")
        seen = stored(seen.unionByName(profile.join(asked, [*by, "page"])), "probed")
    count = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("probed"))
    return boundary(seen, by).join(count, by)
