"""Streams over the event table (survey 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import measurements as M


def _events(spark, sf):
    # The folder's stream takes this one file; new files of the name would follow.
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def streamed_windows(spark, sf):
    found = M.run_windows(M.windowed(_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "user_id", "6 hours"), ["start", "end", "event_type"])
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("long").alias("total"))


def streamed_upsert(spark, sf):
    return M.run_upsert(_events(spark, sf).select("event_id", "ts", "user_id", "event_type"), ["user_id"], "ts", "event_id")


def streamed_once(spark, sf):
    """Each user's kinds of events once, however often they come."""
    rows = _events(spark, sf).filter("ts IS NOT NULL").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return M.run_once(rows, ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type")


def sliding_windows(spark, sf):
    rows = _events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), "user_id")
    found = M.run_windows(M.windowed(rows, "ts", ["kind"], "user_id", "6 hours", "3 hours"), ["start", "end", "kind"])
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.col("total").cast("long").alias("total"))


QUERIES = {f.__name__: f for f in (streamed_windows, streamed_upsert, streamed_once, sliding_windows)}

SQL = {
    "streamed_windows": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "streamed_upsert": "SELECT event_id, ts, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "streamed_once": "SELECT DISTINCT user_id, event_type FROM events WHERE ts IS NOT NULL",
    "sliding_windows": """WITH e AS (SELECT ts, CASE WHEN event_type <> 'view' THEN event_type END AS kind, user_id, unnest([0, 3]) AS back FROM events WHERE ts IS NOT NULL)
      SELECT time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') - to_hours(back) AS start, kind, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM e GROUP BY 1, 2""",
}
