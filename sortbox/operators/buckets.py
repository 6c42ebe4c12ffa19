"""A stored table in hash buckets of its key, of which an upsert rewrites only the touched ones.

A row never leaves its bucket, so an upsert reads and replaces the folders of the incoming keys' buckets
and leaves all other files as they are.  The folders are replaced together when the job commits: a run
that fails before that leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _name(buckets: int) -> str:
    return f"bucket_of_{buckets}"  # another number of buckets is another column, which the table lacks


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, key: str = "message_id", buckets: int = 256) -> str:
    """Write a new bucketed table."""
    name = _name(buckets)
    out = df.withColumn(name, bucket_of(key, buckets)).repartition(name)
    out.write.mode("errorifexists").partitionBy(name).parquet(path)
    return path


def read_bucketed(spark, path: str, buckets: int = 256) -> DataFrame:
    return spark.read.parquet(path).drop(_name(buckets))


def upsert_bucketed(
    path: str, incoming: DataFrame, upsert: Callable[[DataFrame, DataFrame], DataFrame], key: str = "message_id", buckets: int = 256
) -> list[int]:
    """Apply ``upsert(stored rows, incoming)`` to the buckets that ``incoming`` touches, which are returned.

    ``upsert`` gets the stored rows of those buckets and returns their new contents with the same columns
    (``store.upsert_emails`` and ``store.upsert_features`` do).  An empty ``incoming`` changes nothing."""
    spark, name = incoming.sparkSession, _name(buckets)
    ensure_checkpoint_dir(spark)
    incoming = incoming.checkpoint()  # read for the bucket numbers and for the upsert
    touched = sorted(r[0] for r in incoming.select(bucket_of(key, buckets)).distinct().collect())
    if not touched:
        return []
    stored = spark.read.parquet(path).filter(F.col(name).isin(touched))
    columns = [c for c in stored.columns if c != name]
    new = upsert(stored.drop(name), incoming).select(*columns).withColumn(name, bucket_of(key, buckets))
    new.repartition(name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    return touched
