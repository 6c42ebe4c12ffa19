"""A table written epoch by epoch, with compaction.

``<path>/epochs/epoch=N`` holds what epoch N wrote; writing it again replaces it.  ``<path>/bases/upto=N``
holds the fold of all rows up to epoch N.  A reader takes the newest complete base before its epoch and
the epochs after that base, so a job reads a bounded number of folders however long it has run.  Epochs
that the base before the newest one holds are deleted: a replayed epoch still finds what it read.  The
schema is stated, so that an epoch without rows is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import path_exists


class EpochLog:
    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: list[str] | None = None):
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, partition_by or []

    def _numbers(self, folder: str) -> list[int]:
        """Numbers of the complete folders ``<name>=<number>``, ascending."""
        if not path_exists(self.spark, f"{self.path}/{folder}"):
            return []
        hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(hpath) if s.isDirectory() and "=" in s.getPath().getName()]
        return sorted(int(n.split("=")[1]) for n in names if path_exists(self.spark, f"{self.path}/{folder}/{n}/_SUCCESS"))

    def _write(self, df: DataFrame, folder: str) -> None:
        w = df.repartition(*self.partition_by).write.partitionBy(*self.partition_by) if self.partition_by else df.write
        w.mode("overwrite").parquet(f"{self.path}/{folder}")

    def write(self, df: DataFrame, epoch: int) -> None:
        self._write(df, f"epochs/epoch={epoch}")

    def start(self, df: DataFrame) -> None:
        """Write what the table holds before its first epoch."""
        self._write(df, "bases/upto=-1")

    def epoch(self, epoch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/epochs/epoch={epoch}")

    def last(self, before: int | None = None) -> int | None:
        """The newest epoch (before ``before``)."""
        found = [e for e in self._numbers("epochs") if before is None or e < before]
        return found[-1] if found else None

    def rows(self, before: int | None = None) -> DataFrame | None:
        """All rows (of the epochs before ``before``) with their epoch; a base's rows have the base's.
        None when nothing is written."""
        bases = [b for b in self._numbers("bases") if before is None or b < before]
        base = bases[-1] if bases else -1
        epochs = [e for e in self._numbers("epochs") if e > base and (before is None or e < before)]
        out = None
        if epochs:
            paths = [f"{self.path}/epochs/epoch={e}" for e in epochs]
            out = self.spark.read.option("basePath", f"{self.path}/epochs").schema(f"{self.schema}, epoch bigint").parquet(*paths)
        if bases:
            old = self.spark.read.schema(self.schema).parquet(f"{self.path}/bases/upto={base}").withColumn("epoch", F.lit(base).cast("long"))
            out = old if out is None else out.unionByName(old)
        return out

    def compact(self, epoch: int, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Write the base up to ``epoch``; ``fold`` turns the rows so far into the rows to keep."""
        before = self._numbers("bases")
        self._write(fold(self.rows(epoch + 1).drop("epoch")), f"bases/upto={epoch}")
        older = [b for b in before if b < epoch]
        if not older:
            return
        gone = [f"epochs/epoch={e}" for e in self._numbers("epochs") if e <= older[-1]] + [f"bases/upto={b}" for b in older[:-1]]
        for folder in gone:
            hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
