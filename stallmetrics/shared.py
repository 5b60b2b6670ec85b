"""The folder that driver and executors share, and tables written to it once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir. Only a local master may go without the setting; it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/stallmetrics-shared"
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again: for what a plan uses more than once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame, folder: str) -> None:
    """Deletes a folder of the session's file system."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in the order from 1 on, by a sort over ranges and the ranges' sizes; no row goes to one place."""
    own = uuid.uuid4().hex
    at, part, before = f"_a{own}", f"_p{own}", f"_b{own}"
    placed = stored(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    found = placed.join(F.broadcast(offsets), F.shiftright(at, 33) == F.col(part))
    return found.withColumn(name, F.col(before) + F.col(at) - F.shiftleft(part, 33) + 1).drop(at, part, before)


def newest(rows: DataFrame, key: list, order: list) -> DataFrame:
    """Of each key the first row in the order. Each task keeps one row of a key before the shuffle."""
    place = f"_n{uuid.uuid4().hex}"
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(place) == 1).drop(place)
