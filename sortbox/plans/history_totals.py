"""The history that triage needs, as running totals kept up by deltas.

A totals table has a row per sender and per domain (mails and read mails) and one per sender and time
bucket (the latest date): no bodies, and far fewer rows than mail.  A run adds the totals of its mail and
takes off those of the rows that it replaces, so keeping the history costs as much as the new mail.
Counts may be negative in a table of deltas; ``fold`` adds up any number of them.

A latest date is never taken back: it is exact as long as mail that is triaged again keeps its sender
and date, as the provider's messages do.  A null sender has totals of its own that no mail looks up.
Empty tables give empty totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import history as H

SCHEMA = "kind string, key string, bucket bigint, n bigint, r bigint, t timestamp_ntz"
BUCKET_SECONDS = 3600


def scoped(key: Column, by: list[str] | None) -> Column:
    """``key`` within the ``by`` columns (say, a mailbox)."""
    return F.to_json(F.struct(*[F.col(k) for k in by], key.alias("k"))) if by else key


def domain_key(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", -1))


def totals(mail: DataFrame, bucket_seconds: int = BUCKET_SECONDS, by: list[str] | None = None) -> DataFrame:
    """The totals (``SCHEMA``) of a mail table with message_id, from_address, date and was_read."""
    none_b, none_t = F.lit(None).cast("bigint"), F.lit(None).cast("timestamp_ntz")
    sender, domain = scoped(F.col("from_address"), by), scoped(domain_key(F.col("from_address")), by)
    row = lambda kind, key, bucket, t: F.struct(F.lit(kind).alias("kind"), key.alias("key"), bucket.alias("bucket"), t.alias("t"))
    kinds = F.array(
        row("sender", sender, none_b, none_t),
        row("last", sender, H.time_bucket(F.col("date"), bucket_seconds), F.col("date").cast("timestamp_ntz")),
        row("domain", domain, none_b, none_t),
    )
    kinds = F.filter(kinds, lambda k: (k["kind"] != "domain") | F.col("from_address").contains("@"))
    rows = mail.select(F.col("was_read").cast("int").alias("rd"), F.inline(kinds))
    return rows.groupBy("kind", "key", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rd"), F.lit(0)).cast("bigint").alias("r"), F.max("t").alias("t")
    )


def deltas(old: DataFrame, new: DataFrame, bucket_seconds: int = BUCKET_SECONDS, by: list[str] | None = None) -> DataFrame:
    """What replacing the rows ``old`` by ``new`` changes; ``old`` are the stored rows of the ids in ``new``."""
    gone = totals(old, bucket_seconds, by).where("kind <> 'last'")
    return totals(new, bucket_seconds, by).unionByName(gone.withColumns({"n": -F.col("n"), "r": -F.col("r")}))


def fold(rows: DataFrame) -> DataFrame:
    """Totals and deltas added up."""
    return rows.groupBy("kind", "key", "bucket").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.max("t").alias("t"))
