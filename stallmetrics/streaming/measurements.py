"""Measurements as Structured Streaming: late rows, duplicates, windows and upserts (survey R2, R6-R10, R14, K1).

Every stream runs from a checkpoint in the folder that driver and executors share, so a lost executor or driver
costs a micro-batch; sinks are idempotent, so a batch that runs again changes nothing.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import newest as first_of
from ..shared import shared_dir

LATE = "90 minutes"


def once(stream: DataFrame, key: list[str], at: str, late: str = LATE) -> DataFrame:
    """Each key once among rows that come within `late` of each other; the state is dropped behind the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def is_missed(due_at: Column, seen_at: Column, minutes: int = 90) -> Column:
    """R2: a row that came too late is marked rather than dropped; a null time isn't missed."""
    return F.coalesce(seen_at > due_at + F.make_dt_interval(mins=F.lit(minutes)), F.lit(False))


def windowed(stream: DataFrame, at: str, by: list[str], value: str, width: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Rows and the sum of value by window and columns `by`; batch frames give the same. Null times are in no window."""
    grouped = stream.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("window"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def newest(old: DataFrame | None, batch: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key of both; an older measurement never overwrites a newer one, whenever it comes."""
    both = batch if old is None else old.unionByName(batch)
    return first_of(both, key, [F.desc_nulls_last(at), F.desc_nulls_last(tie)])


def _version(spark: SparkSession, base: str) -> int | None:
    """The newest version of a table of versions."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/v*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((int(x.getPath().getParent().getName()[1:]) for x in found), default=None)


def _run(stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], mode: str, base: str) -> DataFrame:
    """Reads all that is there now. Batch n writes version n from version n - 1, both under `base` beside the checkpoint.

    So a stream that is started again with the same base goes on from what it has, and a batch that runs again
    writes the same version again. Versions before the last two are deleted.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(stream.schema).parquet(f"{base}/v{number - 1}") if number else None
        merge(before, batch).write.mode("overwrite").parquet(f"{base}/v{number}")
        if number > 1:
            old = session._jvm.org.apache.hadoop.fs.Path(f"{base}/v{number - 2}")
            old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = _version(spark, base)
    return spark.createDataFrame([], stream.schema) if last is None else spark.read.schema(stream.schema).parquet(f"{base}/v{last}")


def run_upsert(stream: DataFrame, key: list[str], at: str, tie: str, base: str | None = None) -> DataFrame:
    """The table that newest() keeps. base: the folder of the table and its checkpoint, the same at each start; None for a new one."""
    base = base or f"{shared_dir(stream.sparkSession)}/upsert-{uuid.uuid4().hex}"
    return _run(stream, lambda old, batch: newest(old, batch, key, at, tie), "append", base)


def run_windows(aggregated: DataFrame, key: list[str], base: str | None = None) -> DataFrame:
    """A streaming aggregate as a table: windows that a batch has changed replace their rows. State behind the watermark is dropped."""
    base = base or f"{shared_dir(aggregated.sparkSession)}/windows-{uuid.uuid4().hex}"

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        if old is None:
            return batch
        changed = batch.select(*[F.col(k).alias(f"_new_{k}") for k in key])
        # A null in `by` is a group like another.
        same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in key])
        return old.join(changed, same, "left_anti").select(*batch.columns).unionByName(batch)

    return _run(aggregated, merge, "update", base)


def run_once(stream: DataFrame, key: list[str], at: str, late: str = LATE, base: str | None = None) -> DataFrame:
    """The rows that once() lets through, as a table that grows by each batch's."""
    base = base or f"{shared_dir(stream.sparkSession)}/once-{uuid.uuid4().hex}"
    return _run(once(stream, key, at, late), lambda old, batch: batch if old is None else old.unionByName(batch), "append", base)
