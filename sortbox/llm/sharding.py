"""Sharding by sampled splitters, with shard sizes near equal (law ``bytes``).

Records have a total order: by size class (large first), then by the md5 of the text, then by id;
equal texts are therefore neighbours.  Size-weighted samples of that order give splitters that cut it into
ranges of about equal bytes; ranges that come out overfull (a hot text, an unlucky sample) are cut
again at splitters drawn from them alone.  Prefix sums over the ranges and inside each range give
every record its exact place in the order, and the place gives its shard, so the result does not
depend on the sample or on the number of ranges.

Classes are told apart by the share of a mean shard that a record takes (``CLASSES``).  Each class, from
the largest, fills the room that the ones before it left in each shard, so that shards differ by
about the size of the smallest records.  Null text counts as empty with the checksum of no bytes.
Repeated rows (same id and text) each get a slot.  An empty table gives an empty result; columns
other than the named ones are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortbox.llm.tables import stored

SHARDS = 40
OVERHEAD = 16
CLASSES = (4, 16, 64, 256)  # class 0: over 1/4 of a mean shard, and so on
SAMPLES_PER_RANGE = 64
OVERFULL = 2.0
ROUNDS = 3
ORDER = ["tier", "key", "doc_id"]


def _range(splitters: list[tuple]) -> Column:
    """Number of splitters at or below the record (0 without any).

    Every g-th splitter is compared first, then the g of one group, so that a
    record meets about 2 x sqrt(splitters) of them.
    """
    if not splitters:
        return F.lit(0)

    def below(some: list[tuple], part: str = "") -> str:
        text = ", ".join(f"named_struct('tier', {s}, 'key', '{k}', 'doc_id', {d}L)" for s, k, d in some)
        own = "named_struct('tier', tier, 'key', key, 'doc_id', coalesce(doc_id, 0L))"
        return f"size(filter({f'slice(array({text}), {part})' if part else f'array({text})'}, b -> b <= {own}))"

    g = math.isqrt(len(splitters)) + 1
    if len(splitters) < 2 * g:
        return F.expr(below(splitters))
    groups = f"{below(splitters[g - 1 :: g])} * {g}"
    return F.expr(f"{groups} + {below(splitters, f'{groups} + 1, {g}')}")


def _at_or_below(bounds: list[float], x: Column) -> Column:
    """Number of bounds that are at most ``x``."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.expr(f"array({', '.join(f'{e!r}D' for e in bounds)})"), lambda e: e <= x))


def _draw(records: DataFrame, total: int, samples: int, salt: int) -> list[tuple]:
    """About ``samples`` places of the order, drawn with probability in proportion to size.

    The draw hashes the record, so a task that runs again draws the same.  A record as large as
    several shares is drawn once; it cannot be cut anyway.
    """
    chance = F.pmod(F.xxhash64("key", "doc_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    drawn = records.where(chance < F.col("size") * (samples / total)).select("tier", "key", F.coalesce("doc_id", F.lit(0)).alias("doc_id"))
    return sorted(tuple(r) for r in drawn.distinct().collect())


def _quantiles(drawn: list[tuple], parts: int) -> list[tuple]:
    return sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []


def splitters(records: DataFrame, total: int, ranges: int) -> list[tuple]:
    """Boundaries of about ``ranges`` ranges of like size; overfull ranges are cut again.

    At most a few times ``ranges * SAMPLES_PER_RANGE`` keys reach the driver.
    """
    cuts = _quantiles(_draw(records, total, ranges * SAMPLES_PER_RANGE, 0), ranges)
    for salt in range(1, ROUNDS + 1):
        sizes = records.groupBy(_range(cuts).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        over = sizes.where((F.col("bytes") > OVERFULL * total / ranges) & (F.col("n") > 1)).collect()
        if not over:
            break
        more: set[tuple] = set()
        for r in over:
            low, high = [None, *cuts][r["range"]], [*cuts, None][r["range"]]
            inside = records.where(_range([low]) == 1) if low else records
            inside = inside.where(_range([high]) == 0) if high else inside
            parts = max(2, round(r["bytes"] * ranges / total))
            more |= set(_quantiles(_draw(inside, r["bytes"], parts * SAMPLES_PER_RANGE, salt), parts))
        cuts = sorted({*cuts, *more})
    return cuts


def _places(records: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``before`` (bytes) and ``rank`` of every record in the whole order."""
    placed = records.withColumn("range", _range(cuts))
    totals = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: at most len(cuts) + 1 rows, whatever the input.
    starts = totals.select("range", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("range").orderBy(*ORDER)
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        placed.withColumn("b", F.coalesce(before, F.lit(0)))
        .withColumn("n", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "range")
        .select("doc_id", "size", "text_crc32", "tier", (F.col("b0") + F.col("b")).alias("before"), (F.col("n0") + F.col("n")).alias("rank"))
    )


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """Shard and slot of every document under the law ``bytes``."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.md5(body.cast("binary")).alias("key"),
    )
    base = stored(base, "shard-keys")
    total = base.agg(F.sum("size")).first()[0]
    records = base.withColumn("tier", sum(((F.col("size") * (shards * k) <= F.lit(total)).cast("int") for k in CLASSES), F.lit(0)))
    if total is None:
        return records.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = max(2 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = _places(records, splitters(records, total, ranges))

    # Bytes of each class, then of each class in each shard: at most len(CLASSES) + 1 and ``shards`` rows.
    class_bytes = dict(records.groupBy("tier").agg(F.sum("size")).collect())
    middle = F.col("before") + F.col("size") / 2
    taken, begin, choice = [0] * shards, 0, F.lit(None).cast("int")
    for tier, size in sorted(class_bytes.items()):
        room = [max(0, begin + size - shards * t) for t in taken]
        ends = [float(sum(room[: s + 1])) for s in range(shards)]
        scaled = (middle - begin) * (ends[-1] / size)
        here = _at_or_below(ends[:-1], scaled)
        choice = F.when(F.col("tier") == tier, here).otherwise(choice)
        if tier != max(class_bytes):
            for s, t in placed.where(F.col("tier") == tier).groupBy(here.alias("s")).agg(F.sum("size")).collect():
                taken[s] += t
        begin += size
    placed = placed.withColumn("shard", choice)

    # First rank and count of each class in each shard: few rows, whatever the input.
    firsts = placed.groupBy("shard", "tier").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    shifts = firsts.select("shard", "tier", (F.col("first") - F.coalesce(F.sum("n").over(ahead), F.lit(0))).alias("shift"))
    return placed.join(F.broadcast(shifts), ["shard", "tier"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
