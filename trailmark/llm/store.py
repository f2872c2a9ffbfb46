"""Intermediate tables in the folder that the whole cluster shares.

A stage that is used more than once, or that ends an iteration, is written as Parquet under
``spark.checkpoint.dir``.  That cuts the lineage, and a lost executor costs only its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where the machine is the cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="trailmark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables of one operator call, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return it as read back."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        with self._shuffles_end():
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def _shuffles_end(self) -> Iterator[None]:
        """Shuffle files of a written table go with its writing; else they stay until the driver happens to collect its garbage."""
        before = self.spark.conf.get(SHUFFLES_END, None)
        self.spark.conf.set(SHUFFLES_END, "true")
        try:
            yield
        finally:
            self.spark.conf.set(SHUFFLES_END, before) if before else self.spark.conf.unset(SHUFFLES_END)

    def drop(self, df: DataFrame) -> None:
        """Delete a table of ``save`` that nothing will read again."""
        for file in df.inputFiles()[:1]:
            self._delete(file, parent=True)

    def clear(self) -> None:
        """Delete all tables, once nothing reads them any more."""
        self._delete(self.path)

    def _delete(self, path: str, parent: bool = False) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder = folder.getParent() if parent else folder
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
