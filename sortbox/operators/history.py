"""Skew-safe keyed scans: running sums and as-of maxima per key.

A window partitioned by the key alone sorts a hot key (say a third of all
rows) in one task.  Both helpers add a time bucket to the partition key, run
the window inside (key, bucket) and carry totals across buckets through a
per-(key, bucket) table, which has one row per bucket a key occupies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

EPOCH = "1970-01-01 00:00:00"


def epoch_us(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ntz_lit(EPOCH), ts)


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(epoch_us(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def keyed_running_sum(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[Column],
    values: list[str],
    bucket_desc: bool = False,
) -> DataFrame:
    """Adds ``run_<v>``: the sum of ``v`` over all rows of the same ``keys``
    up to and including this row, in (bucket, *order) order.  ``order`` must
    make rows unique within a (keys, bucket) group."""
    bo = F.col(bucket).desc() if bucket_desc else F.col(bucket).asc()
    w_in = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per_bucket = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"_b_{v}") for v in values])
    w_b = Window.partitionBy(*keys).orderBy(bo).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *keys, bucket, *[F.coalesce(F.sum(f"_b_{v}").over(w_b), F.lit(0)).alias(f"_c_{v}") for v in values]
    )
    inner = df.select("*", *[F.sum(v).over(w_in).alias(f"_i_{v}") for v in values])
    j = inner.join(carried, keys + [bucket], "left")
    return j.select(*df.columns, *[(F.col(f"_c_{v}") + F.col(f"_i_{v}")).alias(f"run_{v}") for v in values])


def asof_max_before(
    contributors: DataFrame,
    probes: DataFrame,
    key: str,
    ts: str,
    probe_id: str,
    bucket_seconds: int = 3600,
    latest: DataFrame | None = None,
) -> DataFrame:
    """For each probe row: the latest contributor ``ts`` of the same ``key``
    strictly before the probe's ``ts``.  Returns (probe_id, prev_ts).

    ``latest`` (``key``, bucket, t) may give each key's latest ``ts`` by time
    bucket; of ``contributors`` only the probes' buckets are then needed."""
    c = contributors.select(
        F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(True).alias("_is_c"), F.lit(None).cast("string").alias("_pid")
    ).withColumn("_b", time_bucket(F.col("_t"), bucket_seconds))
    p = probes.select(
        F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(False).alias("_is_c"), F.col(probe_id).cast("string").alias("_pid")
    ).withColumn("_b", time_bucket(F.col("_t"), bucket_seconds))
    probe_buckets = p.select("_k", "_b").distinct()
    # Only contributors in (key, bucket)s that hold probes are sorted; the
    # rest of the history enters through the per-bucket maxima below.
    near = c.join(probe_buckets, ["_k", "_b"], "left_semi")
    u = near.unionByName(p)
    w_in = Window.partitionBy("_k", "_b").orderBy(epoch_us(F.col("_t"))).rangeBetween(Window.unboundedPreceding, -1)
    within = u.withColumn("_prev_in", F.max(F.when(F.col("_is_c"), F.col("_t"))).over(w_in)).filter(~F.col("_is_c"))
    # One row per (key, bucket) holding contributors or probes (a partial
    # aggregate, no sort of the history); the latest contributor of all
    # earlier buckets is carried forward.
    if latest is None:
        per_bucket = c.groupBy("_k", "_b").agg(F.max("_t").alias("_m"))
    else:
        per_bucket = latest.select(F.col(key).alias("_k"), F.col("bucket").alias("_b"), F.col("t").alias("_m"))
        per_bucket = per_bucket.join(p.select("_k").distinct(), "_k", "left_semi")
    all_b = per_bucket.join(probe_buckets, ["_k", "_b"], "full")
    w_all = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    filled = all_b.select("_k", "_b", F.max("_m").over(w_all).alias("_prev_out"))
    j = within.join(filled, ["_k", "_b"], "left")
    return j.select(F.col("_pid").alias(probe_id), F.greatest("_prev_in", "_prev_out").alias("prev_ts"))
