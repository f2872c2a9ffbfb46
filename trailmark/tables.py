"""Tables in the folder that the whole cluster shares; writing one cuts the lineage of what reads it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode, where the machine is the cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="trailmark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """``df``, written as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Tables in folders whose names are ranges of batches; a range counts once its writing has ended, and hides those within it."""

    def __init__(self, path: str):
        self.path = path

    def ranges(self, spark) -> list[tuple[int, int]]:
        """The written ranges that no larger one holds, in order."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        known = [tuple(map(int, n.split("-"))) for n in names if re.fullmatch(r"\d+-\d+", n) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(r for r in known if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in known))

    def folder(self, of: tuple[int, int]) -> str:
        return f"{self.path}/{of[0]}-{of[1]}"

    def read(self, spark, ranges: list[tuple[int, int]]) -> DataFrame:
        return spark.read.parquet(*map(self.folder, ranges))

    def write(self, df: DataFrame, of: tuple[int, int]) -> None:
        df.write.mode("overwrite").parquet(self.folder(of))

    def drop(self, spark, of: tuple[int, int]) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.folder(of))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
