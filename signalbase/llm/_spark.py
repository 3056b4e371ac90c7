"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


class Scratch:
    """Tables of one operator run, in a folder of their own in the shared one.

    ``save`` writes a frame and reads it back, so lineage ends at files that
    every executor sees; a lost executor re-reads them. ``drop`` removes a table
    that nothing needs any more; what is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)


def with_broadcast_if_small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only when its counted rows are within the bound."""
    return F.broadcast(df) if rows <= max_rows else df
