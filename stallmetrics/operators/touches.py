"""A user's touches at least a minute apart (survey X13).

The minute counts from the last touch that was accepted, so what is accepted hangs on all before. Time is cut
into cells of that width: a cell has one accepted touch at most, and after an empty cell the next touch is
accepted whatever was before. So each touch points to the one that would be accepted next (in the next cell,
or the first of the one after), runs of filled cells begin anew, and pointers are doubled from their first
touches on: as many rounds as the logarithm of the longest run, each a join on (user, time). No user's rows
are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def accepted_touches(touches: DataFrame, seconds: int = 60) -> DataFrame:
    """user_id, at of the touches (user_id, at timestamp) that are written; equal ones count once, those with nulls never."""
    width = seconds * 1_000_000
    us = F.unix_micros(F.col("at").cast("timestamp"))
    rows = stored(touches.filter("user_id IS NOT NULL AND at IS NOT NULL").select("user_id", us.alias("us")).distinct().withColumn("cell", F.floor(F.col("us") / width)), "touches")
    first = rows.groupBy("user_id", "cell").agg(F.min("us").alias("least"))
    # Touches of a cell and what asks for the first at or behind a time in it, from the end: the least touch so far answers.
    asks = rows.select("user_id", (F.col("cell") + 1).alias("cell"), (F.col("us") + width).alias("us"), F.col("us").alias("asker"))
    backward = Window.partitionBy("user_id", "cell").orderBy(F.desc("us"), F.col("asker").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    answers = rows.withColumn("asker", F.lit(None).cast("long")).unionByName(asks).withColumn("found", F.min(F.when(F.col("asker").isNull(), F.col("us"))).over(backward)).filter("asker IS NOT NULL")
    # Nothing there, but something in the cell: then the first of the cell behind it.
    filled = first.select("user_id", "cell", F.lit(True).alias("filled"))
    behind = first.select("user_id", (F.col("cell") - 1).alias("cell"), F.col("least").alias("behind"))
    pointed = answers.join(filled, ["user_id", "cell"], "left").join(behind, ["user_id", "cell"], "left")
    jump = pointed.select("user_id", F.col("asker").alias("us"), F.coalesce("found", F.when(F.col("filled"), F.col("behind"))).alias("next")).filter("next IS NOT NULL")
    jump = stored(jump, "jumps")
    before = first.select("user_id", (F.col("cell") + 1).alias("cell"))
    kept = stored(first.join(before, ["user_id", "cell"], "left_anti").select("user_id", F.col("least").alias("us")), "kept")
    while not jump.isEmpty():
        on = kept.join(jump, ["user_id", "us"]).select("user_id", F.col("next").alias("us"))
        kept = stored(kept.unionByName(on).distinct(), "kept")
        further = jump.select("user_id", F.col("us").alias("next"), F.col("next").alias("after"))
        jump = stored(jump.join(further, ["user_id", "next"]).select("user_id", "us", F.col("after").alias("next")), "jumps")
    return kept.select("user_id", F.timestamp_micros("us").alias("at"))
