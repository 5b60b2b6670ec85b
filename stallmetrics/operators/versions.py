"""Compare-and-set over a table of versions (survey X15, K2): a writer whose version has been passed looks again.

Version n is a folder of its own and a claim on the number; the claim is a file that only one writer can create.
Claims need a file system whose create without overwriting is atomic, such as HDFS or a local one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Versions:
    def __init__(self, spark: SparkSession, base: str, schema: str):
        self.spark, self.base, self.schema = spark, base.rstrip("/"), schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> tuple[int, DataFrame | None]:
        """The newest version's number, 0 if there is none, and its rows."""
        pattern, fs = self._fs(f"{self.base}/claims/*")
        names = [x.getPath().getName() for x in fs.globStatus(pattern) or []]
        if not names:
            return 0, None
        n, folder = max((int(x.split("-")[0]), x.split("-")[1]) for x in names if "-" in x)
        return n, self.spark.read.schema(self.schema).parquet(f"{self.base}/data/{folder}")

    def _made(self, path: str) -> bool:
        """Whether this call has created the file; of calls at once only one does."""
        p, fs = self._fs(path)
        fs.mkdirs(p.getParent())
        if fs.getScheme() == "file":  # Hadoop looks first and creates then on a local disk
            try:
                Path(p.toUri().getPath()).touch(exist_ok=False)
            except FileExistsError:
                return False
            return True
        try:
            fs.create(p, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def _claim(self, n: int, folder: str) -> bool:
        """Only one writer makes the n-th lock; it names its folder, under which readers find the version."""
        return self._made(f"{self.base}/locks/{n}") and self._made(f"{self.base}/claims/{n}-{folder}")

    def change(self, of: Callable[[DataFrame | None], DataFrame], tries: int = 20) -> int:
        """Writes of(newest rows) as the next version; if another writer was first, of() is asked again with what that one has written."""
        for _ in range(tries):
            n, rows = self.last()
            folder = uuid.uuid4().hex
            of(rows).write.parquet(f"{self.base}/data/{folder}")
            if self._claim(n + 1, folder):
                return n + 1
            path, fs = self._fs(f"{self.base}/data/{folder}")
            fs.delete(path, True)
        raise RuntimeError(f"no version after {tries} tries")
