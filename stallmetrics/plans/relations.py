"""The marketplace relations of the queries, derived from the tables of the test data, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ad for each (order, line): its part is the product."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("p_partkey"), F.max("l_suppkey").alias("supplier"), F.max("l_extendedprice").alias("e"), F.max("l_quantity").alias("q"), F.max("l_shipdate").alias("posted_at"), F.max(F.col("l_returnflag") == "R").alias("returned")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return lines.join(parts, "p_partkey").select(
        F.concat("l_orderkey", F.lit(":"), "l_linenumber").alias("external_id"),
        F.col("p_type").alias("category"),
        F.concat("p_name", F.lit(" "), "p_brand").alias("title"),
        F.concat(F.lit("fam:"), "p_name", F.lit("|"), "p_brand").alias("family_key"),
        (30 + F.col("p_size") % 20).cast("int").alias("family_confidence"),
        F.floor(F.col("e") / F.col("q")).cast("int").alias("price_eur"),
        "posted_at",
        F.when(F.col("l_linenumber") != 7, (F.col("q") * F.col("l_linenumber")).cast("int")).alias("view_count"),
        F.col("returned").alias("is_promoted"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ordinal"),
        F.lower(F.trim(F.regexp_replace(F.lower(F.concat("p_name", F.lit(" "), "p_brand")), "[^a-z0-9]+", " "))).alias("normal"),
        "l_orderkey",
        "l_linenumber",
        F.col("q").cast("int").alias("quantity"),
    )


OFFERS = """offers AS (
  SELECT CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS external_id, p_type AS category, p_name || ' ' || p_brand AS title,
    'fam:' || p_name || '|' || p_brand AS family_key, CAST(30 + p_size % 20 AS INTEGER) AS family_confidence, CAST(floor(e / q) AS INTEGER) AS price_eur, posted_at,
    CASE WHEN l_linenumber <> 7 THEN CAST(q * l_linenumber AS INTEGER) END AS view_count, rf = 'R' AS is_promoted, l_orderkey * 10 + l_linenumber AS ordinal,
    trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS normal, l_orderkey, l_linenumber, CAST(q AS INTEGER) AS quantity
  FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p_partkey, max(l_extendedprice) AS e, max(l_quantity) AS q, max(l_shipdate) AS posted_at, max(l_returnflag) AS rf
        FROM lineitem GROUP BY ALL) JOIN part USING (p_partkey))"""


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of a part by day: one point for each (part, day)."""
    points = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_shipdate").agg(F.max(F.floor(F.col("l_extendedprice") / F.col("l_quantity"))).cast("int").alias("price_eur"))
    return points.select(F.col("l_partkey").cast("string").alias("external_id"), "price_eur", F.col("l_shipdate").alias("recorded_at"), F.lit(0).cast("long").alias("id"))


HISTORY = """history AS (SELECT CAST(l_partkey AS VARCHAR) AS external_id, CAST(max(floor(l_extendedprice / l_quantity)) AS INTEGER) AS price_eur, l_shipdate AS recorded_at
  FROM lineitem GROUP BY l_partkey, l_shipdate)"""


def views(spark: SparkSession, sf_dir: str, ads: DataFrame | None = None) -> DataFrame:
    """Three view counts of each ad, eight hours apart; those of every fifth line fall. ads: offers(), where they are at hand."""
    step = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    o = (offers(spark, sf_dir) if ads is None else ads).select("external_id", "posted_at", "quantity", "l_linenumber", step)
    count = F.when(F.col("l_linenumber") == 5, 100 - F.col("k")).otherwise(F.col("quantity") * F.col("k") + F.col("l_linenumber"))
    return o.select("external_id", F.col("k").cast("long").alias("id"), count.cast("int").alias("view_count"), (F.col("posted_at") + F.make_dt_interval(hours=F.col("k") * 8)).alias("recorded_at"))


VIEWS = """views AS (SELECT external_id, k AS id, CASE WHEN l_linenumber = 5 THEN 100 - k ELSE quantity * k + l_linenumber END AS view_count,
  posted_at + to_hours(CAST(k * 8 AS BIGINT)) AS recorded_at FROM (SELECT *, unnest([0, 1, 2]) AS k FROM offers))"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scans of a category (their priority)."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    return o.select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderpriority").alias("category"), status.alias("status"), F.col("o_orderdate").alias("finished_at"), (F.col("o_orderkey") % 7 != 0).alias("is_complete"), (F.col("o_orderkey") % 5).cast("int").alias("rows"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("amount"))


SCANS = """scans AS (SELECT o_orderkey AS scan_id, o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
  o_orderdate AS finished_at, o_orderkey % 7 <> 0 AS is_complete, CAST(o_orderkey % 5 AS INTEGER) AS rows, o_custkey AS user_id, o_totalprice AS amount FROM orders)"""
