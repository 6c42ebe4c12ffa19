"""Filters, projections, lookups and limits over the mail tables.

All filters are plain predicates so Catalyst pushes them into the parquet
scan; all "top n" reads are ``orderBy(...).limit(n)`` which plans as
TakeOrderedAndProject (per-partition top-n, then one small merge).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

from ..functions import columns as C

# Built-in categories of the rule-based categoriser, in order.
BUILT_IN_CATEGORIES = [
    "Bot/Newsletter-Tech",
    "Bot/Newsletter-Finance",
    "Bot/Newsletter-News",
    "Bot/Newsletter-Other",
    "Bot/Promotional",
    "Bot/Automated",
    "Bot/Personal",
    "Bot/Work",
    "Bot/Receipts",
    "Bot/LowConfidence",
    "Bot/AutoArchived",
]


def _newest_first(df: DataFrame, ts: str = "date") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col("message_id"))


def email_by_id(emails: DataFrame, message_id: str) -> DataFrame:
    return emails.filter(F.col("message_id") == message_id)


def emails_by_ids(emails: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """IN-list lookup.  A list becomes an ``isin`` predicate (pushed to the
    scan); a DataFrame of ids becomes a semi join (AQE broadcasts it when
    it is small, otherwise it is a shuffled semi join)."""
    if isinstance(ids, list):
        return emails.filter(F.col("message_id").isin(ids))
    return emails.join(ids.select("message_id"), "message_id", "left_semi")


def list_emails(emails: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first.  A falsy ``limit`` returns everything and ignores offset."""
    ordered = _newest_first(emails)
    if not limit:
        return ordered
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def emails_by_sender(emails: DataFrame, address: str, limit: int | None = None) -> DataFrame:
    out = _newest_first(emails.filter(F.col("from_address") == address))
    return out.limit(limit) if limit else out


def unread_emails(emails: DataFrame, limit: int | None = None) -> DataFrame:
    out = _newest_first(emails.filter(F.col("was_read") == F.lit(False)))
    return out.limit(limit) if limit else out


def emails_in_range(emails: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """start <= date <= end, both inclusive."""
    lo = ntz_lit(start)
    hi = ntz_lit(end)
    return _newest_first(emails.filter((F.col("date") >= lo) & (F.col("date") <= hi)))


def count_emails(emails: DataFrame) -> DataFrame:
    return emails.agg(F.count(F.lit(1)).alias("n_emails"))


def actions_for_email(actions: DataFrame, message_id: str) -> DataFrame:
    return actions.filter(F.col("message_id") == message_id).orderBy("timestamp", "action_id")


def with_label_views(emails: DataFrame) -> DataFrame:
    return emails.select(
        "message_id", C.user_labels("labels").alias("user_labels"), C.bot_labels("labels").alias("bot_labels")
    )


def features_by_id(features: DataFrame, message_id: str) -> DataFrame:
    return features.filter(F.col("message_id") == message_id)


def has_features(features: DataFrame, message_id: str) -> DataFrame:
    return features.filter(F.col("message_id") == message_id).agg(
        (F.count(F.lit(1)) > 0).alias("has_features")
    )


def has_features_each(ids: DataFrame, features: DataFrame) -> DataFrame:
    """The membership flag for every ``message_id`` of ``ids``."""
    known = features.select("message_id").distinct().withColumn("_known", F.lit(True))
    return ids.select("message_id").join(known, "message_id", "left").select("message_id", F.coalesce("_known", F.lit(False)).alias("has_features"))


def count_features(features: DataFrame) -> DataFrame:
    return features.agg(F.count(F.lit(1)).alias("n_features"))


def features_for_ids(features: DataFrame, ids: DataFrame) -> DataFrame:
    """One output slot per requested id, in request order (``pos``); NULL
    feature columns where the id has no features.  ``ids`` has columns
    (pos, message_id)."""
    return ids.join(features, "message_id", "left").orderBy("pos")


def list_features(features: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    ordered = features.orderBy(F.col("computed_at").desc(), F.col("message_id"))
    if not limit:
        return ordered
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def custom_labels(mappings: DataFrame) -> DataFrame:
    return mappings.select("label").distinct()


def all_categories(spark, mappings: DataFrame) -> DataFrame:
    """Built-in categories followed by custom labels not already built in."""
    built = spark.createDataFrame(
        [(i, c) for i, c in enumerate(BUILT_IN_CATEGORIES)], "pos bigint, label string"
    )
    custom = custom_labels(mappings).join(F.broadcast(built.select("label")), "label", "left_anti")
    return built.select("label", F.lit(True).alias("built_in")).unionByName(
        custom.select("label", F.lit(False).alias("built_in"))
    )


def unused_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.filter(F.col("used_in_training") == F.lit(False)).select(
        "message_id", "decision_correct", "label_correct", "correct_decision", "correct_label", "user_comment"
    )


def label_prompts(emails: DataFrame) -> DataFrame:
    """Prompt table for an external labeller: sender name else address,
    subject default, first 200 characters of the snippet."""
    return emails.select(
        "message_id",
        F.coalesce(C.blank_to_null("from_name"), F.col("from_address")).alias("sender"),
        F.coalesce(C.blank_to_null("subject"), F.lit("(no subject)")).alias("subject"),
        F.substring(F.coalesce(F.col("snippet"), F.lit("")), 1, 200).alias("snippet"),
    )
