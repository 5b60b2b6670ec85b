"""Administration: statistics, lists, subscriptions (survey Q17, Q20, A15-A18, X9-X14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def admin_stats(users: DataFrame, scans: DataFrame, payments: DataFrame, as_of: Column) -> DataFrame:
    """One row of counts and sums; each table is aggregated once."""
    day = as_of - F.expr("INTERVAL 24 HOURS")
    n = F.count(F.lit(1))
    active = ~F.col("is_banned") & (F.col("access_until") > as_of)
    u = users.agg(n.alias("total_users"), F.count_if(active).alias("active_users"), F.count_if(F.col("last_seen_at") >= day).alias("active_24h"), F.count_if(F.col("joined_at") >= day).alias("new_24h"))
    s = scans.agg(n.alias("total_scans"), F.count_if(F.col("created_at") >= day).alias("scans_24h"))
    paid = F.col("status") == "paid"
    money = lambda when: F.coalesce(F.sum(F.when(when, F.col("amount"))), F.lit(0.0))
    p = payments.agg(F.count_if(F.col("status") == "pending").alias("pending_payments"), F.count_if(paid).alias("paid_count"), money(paid).alias("paid_total"), money(paid & (F.col("paid_at") >= day)).alias("paid_24h"))
    # Three single rows side by side.
    return u.join(s, F.lit(True)).join(p, F.lit(True))


def user_payments(payments: DataFrame, limit: int = 20) -> DataFrame:
    """Q20: each user's latest payments."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("payment_id"))
    return payments.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def extended_access(until: Column, days: Column, as_of: Column) -> Column:
    """What is left, or now, and so many days more."""
    return F.greatest(F.coalesce(until, as_of), as_of) + F.make_dt_interval(days)


def payment_state(status: Column, remote: Column, expires_at: Column, as_of: Column, grace: int = 15) -> Column:
    """X11: a pending payment is paid once that is verified, failed if its sum is wrong, expired after a grace."""
    over = as_of > expires_at + F.expr(f"INTERVAL {grace} MINUTES")
    return F.when(status != "pending", status).when(remote == "paid", "paid").when(remote == "mismatch", "failed").when((remote == "expired") | over, "expired").otherwise(status)


def valid_price(price: Column) -> Column:
    """In two decimals, above 0 and at most 100000; else null."""
    exact = F.bround(price, 2)
    return F.when((exact > 0) & (exact <= 100_000), exact)


def live_totals(beats: DataFrame, as_of: Column, columns: list[str], seconds: int = 20) -> DataFrame:
    """Workers with a recent heartbeat by role, and sums of their counters."""
    live = beats.filter(F.col("beat_at") >= as_of - F.expr(f"INTERVAL {seconds} SECONDS"))
    return live.groupBy("role").agg(F.count_distinct("worker_id").alias("workers"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def scan_quality(pages: DataFrame) -> DataFrame:
    """Of each scan, pages counted once with their last attempt, and the share of them that are verified and not suspicious (our own score)."""
    last = pages.groupBy("scan_id", "page").agg(F.max_by(F.struct("verified", "suspicious", "items"), "attempt").alias("_p"), F.count(F.lit(1)).alias("attempts"))
    good = F.col("_p.verified") & ~F.col("_p.suspicious")
    return last.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("attempts").alias("attempts"), F.count_if(good).alias("good_pages"), F.sum("_p.items").alias("items"), F.bround(100 * F.avg(good.cast("double"))).cast("int").alias("quality")
    )
