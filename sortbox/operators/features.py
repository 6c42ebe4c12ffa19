"""Feature operators: metadata, sender/domain statistics, as-of previous
email, and the combined historical feature set.

Scale notes
-----------
* Sender and domain statistics are partial (map-side) aggregates, so a hot
  sender costs one combined row per map task, not a hot reducer.
* ``previous_email`` is an as-of self join.  A plain window partitioned by
  sender would sort a hot sender (possibly a third of all mail) in one
  task.  We split each sender's timeline into time buckets: the window runs
  per (sender, bucket) and a small per-bucket maximum table carries the
  latest earlier date across buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

METADATA_FEATURES = [
    "sender_domain",
    "sender_address_hash",
    "is_newsletter",
    "day_of_week",
    "hour_of_day",
    "subject_length",
    "body_length",
    "has_attachments",
    "thread_length",
]
HISTORICAL_FEATURES = ["sender_email_count", "sender_open_rate", "sender_days_since_last", "domain_open_rate"]


def metadata_columns(thread_length: Column | None = None) -> list[Column]:
    """The nine metadata features as Columns over an emails DataFrame."""
    return [
        C.sender_domain("from_address").alias("sender_domain"),
        C.sender_hash("from_address").alias("sender_address_hash"),
        C.is_newsletter("labels", "subject", "body_plain").alias("is_newsletter"),
        C.day_of_week("date").alias("day_of_week"),
        C.hour_of_day("date").alias("hour_of_day"),
        C.text_length("subject").alias("subject_length"),
        C.text_length("body_plain").alias("body_length"),
        F.lit(False).alias("has_attachments"),
        (thread_length if thread_length is not None else F.lit(1).cast("bigint")).alias("thread_length"),
    ]


def metadata_features(emails: DataFrame, count_threads: bool = False) -> DataFrame:
    """message_id + the nine metadata features.  ``count_threads`` turns the
    thread_length stub into the declared meaning (mails per thread)."""
    if not count_threads:
        return emails.select("message_id", *metadata_columns())
    # An aggregate and a join of narrow rows: a long thread is not gathered in
    # one task, and no bodies are shuffled.
    counts = emails.groupBy(F.col("thread_id").alias("_thread")).agg(F.count(F.lit(1)).alias("_n"))
    rows = emails.select("message_id", "thread_id", *metadata_columns())
    joined = rows.join(counts, F.col("thread_id").eqNullSafe(F.col("_thread")))
    return joined.withColumn("thread_length", F.col("_n")).select(*[c for c in rows.columns if c != "thread_id"])


def sender_stats(emails: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per exact sender address: total, read/archived counts and rates."""
    keys = (by or []) + ["from_address"]
    return emails.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.count_if(F.col("was_read")).alias("read_count"),
        F.count_if(F.col("was_archived")).alias("archived_count"),
    ).select(
        *keys,
        "total_emails",
        "read_count",
        (F.col("read_count") / F.col("total_emails")).alias("open_rate"),
        "archived_count",
        (F.col("archived_count") / F.col("total_emails")).alias("archive_rate"),
    )


def sender_stats_for(addresses: DataFrame, emails: DataFrame) -> DataFrame:
    """Stats for the given addresses; unknown senders get zeros."""
    st = sender_stats(emails)
    return addresses.select("from_address").distinct().join(st, "from_address", "left").select(
        "from_address",
        F.coalesce("total_emails", F.lit(0)).alias("total_emails"),
        F.coalesce("read_count", F.lit(0)).alias("read_count"),
        F.coalesce("open_rate", F.lit(0.0)).alias("open_rate"),
        F.coalesce("archived_count", F.lit(0)).alias("archived_count"),
        F.coalesce("archive_rate", F.lit(0.0)).alias("archive_rate"),
    )


def domain_stats(emails: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Open rate per domain, where a domain's mails are the addresses ending
    in '@domain' (ASCII case-insensitive).  Addresses without '@' belong to
    no domain."""
    keys = by or []
    return (
        emails.filter(F.col("from_address").contains("@"))
        .groupBy(*keys, F.lower(F.substring_index("from_address", "@", -1)).alias("domain"))
        .agg(F.count(F.lit(1)).alias("domain_total"), F.count_if(F.col("was_read")).alias("domain_read"))
        .select(*keys, "domain", "domain_total", (F.col("domain_read") / F.col("domain_total")).alias("domain_open_rate"))
    )


def previous_email(
    emails: DataFrame,
    key: str = "from_address",
    ts: str = "date",
    bucket_seconds: int = 3600,
    by: list[str] | None = None,
) -> DataFrame:
    """For every mail: the latest ``ts`` of the same ``key`` strictly earlier.

    Returns message_id, ``prev_date``.  Ties (same timestamp) are not earlier.
    """
    keys = (by or []) + [key]
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    base = emails.select("message_id", *keys, ts).withColumn(
        "_bucket", F.floor(us / F.lit(bucket_seconds * 1_000_000)).cast("bigint")
    )
    w_in = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(us)
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    within = base.withColumn("_prev_in", F.max(ts).over(w_in))
    # Latest date of each (key, bucket); then the max over earlier buckets.
    per_bucket = base.groupBy(*keys, "_bucket").agg(F.max(ts).alias("_bucket_max"))
    w_b = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(*keys, "_bucket", F.max("_bucket_max").over(w_b).alias("_prev_out"))
    joined = within.join(carried, keys + ["_bucket"], "left")
    return joined.select(
        "message_id", *(by or []), F.greatest("_prev_in", "_prev_out").alias("prev_date")
    )


def historical_features(
    emails: DataFrame, bucket_seconds: int = 3600, targets: DataFrame | None = None, by: list[str] | None = None
) -> DataFrame:
    """Snapshot-mode history features for every mail in ``emails`` (or only
    for ``targets``, a subset of it, with ``emails`` as the history).

    Counts and rates cover all mail of the sender in the table (including the
    mail itself and later mail); days-since-last uses strictly earlier mail.
    ``by`` adds partition columns (e.g. a mailbox id): statistics are then
    kept per (mailbox, sender), so many mailboxes run as one job.
    """
    from .history import asof_max_before

    keys = by or []
    st = sender_stats(emails, keys).select(
        *keys, "from_address", F.col("total_emails").alias("sender_email_count"), F.col("open_rate").alias("sender_open_rate")
    )
    dom = domain_stats(emails, keys).select(*keys, F.col("domain").alias("_dom"), "domain_open_rate")
    # (mailbox, message) identity: message ids are only unique per mailbox.
    pid = F.to_json(F.struct(*keys, "message_id")) if keys else F.col("message_id")
    if targets is None:
        prev = previous_email(emails, bucket_seconds=bucket_seconds, by=keys)
        prev = prev.select(pid.alias("_pid"), "prev_date")
        rows = emails
    else:
        rows = targets
        sk = F.to_json(F.struct(*keys, "from_address")) if keys else F.col("from_address")
        prev = asof_max_before(
            emails.withColumn("_sk", sk), targets.withColumn("_sk", sk).withColumn("_pid", pid), "_sk", "date", "_pid",
            bucket_seconds,
        ).withColumnRenamed("prev_ts", "prev_date")
    base = rows.select(
        "message_id", *keys, "from_address", "date", C.sender_domain("from_address").alias("_dom"), pid.alias("_pid")
    )
    out = (
        base.join(st, keys + ["from_address"], "left")
        .join(dom, keys + ["_dom"], "left")
        .join(prev, "_pid", "left")
    )
    return out.select(
        "message_id",
        *keys,
        F.coalesce("sender_email_count", F.lit(0)).cast("bigint").alias("sender_email_count"),
        F.coalesce("sender_open_rate", F.lit(0.0)).alias("sender_open_rate"),
        C.days_between(F.col("date"), F.col("prev_date")).alias("sender_days_since_last"),
        F.coalesce("domain_open_rate", F.lit(0.0)).alias("domain_open_rate"),
    )


def email_features(emails: DataFrame, embeddings: DataFrame | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """Full feature row per mail (metadata + historical [+ embeddings])."""
    meta = metadata_features(emails)
    hist = historical_features(emails, bucket_seconds=bucket_seconds)
    out = meta.join(hist, "message_id")
    if embeddings is not None:
        out = out.join(embeddings.select("message_id", "subject_embedding", "body_embedding"), "message_id", "left")
    else:
        out = out.withColumn("subject_embedding", F.lit(None).cast("array<double>")).withColumn(
            "body_embedding", F.lit(None).cast("array<double>")
        )
    return out
