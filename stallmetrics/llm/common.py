"""What the operators share: tables, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a side whose rows are of fixed small width may be broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of what goes to a Python worker at once, and of a row group: small, as each running task holds one.
BATCH_BYTES, ROW_GROUP = 8_000_000, 16 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may go without the setting; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/stallmetrics-shared"
    return found.rstrip("/")


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cleaned_up(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Within it, Spark deletes a query's shuffle files as soon as the query is done."""
    return _set(spark, {CLEANUP: "true"})


def give_back() -> None:
    """Gives memory that a worker has freed back to the system; an idle worker would hold it while others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, whose workers keep little between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(batches)
        give_back()

    return df.mapInArrow(run, schema)


class Stored:
    """A DataFrame written once to the shared folder; lost executors cost no recomputation."""

    def __init__(self, df: DataFrame, name: str, batch_bytes: int = BATCH_BYTES):
        """batch_bytes: of what goes to a Python worker at once."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        with _set(self.spark, {CLEANUP: "true", BATCH: str(batch_bytes)}):
            df.write.option("parquet.block.size", ROW_GROUP).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; for tables that later results no longer read."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and th, a hash of the text that tells rows of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on the key of keyed(); a null doc_id equals a null doc_id."""
    return (a["th"] == b["th"]) & a["doc_id"].eqNullSafe(b["doc_id"])
