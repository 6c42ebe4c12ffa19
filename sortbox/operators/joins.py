"""Join-shaped operators over mail, features, labels and actions.

Every "minus" is a ``left_anti`` join and every "exists" a ``left_semi``
join: both plan as hash/sort-merge joins on message_id (AQE broadcasts
the small side when its measured size allows), never as a NOT IN with
null-aware nested loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def emails_with_features(emails: DataFrame, features: DataFrame, min_sender_count: int = 2) -> DataFrame:
    j = emails.join(features.drop("sender_domain") if "sender_domain" in emails.columns else features, "message_id", "inner")
    return j.filter(F.col("sender_email_count") >= min_sender_count)


def emails_without_features(
    emails: DataFrame, features: DataFrame, limit: int | None = None, ordered: bool = True
) -> DataFrame:
    """Mail without a feature row, newest first.  ``ordered=False`` skips
    the global sort when the caller only needs the set (the feature build);
    with a limit the order is always applied (top-n, no full sort)."""
    out = emails.join(features.select("message_id"), "message_id", "left_anti")
    if limit:
        return out.orderBy(F.col("date").desc(), F.col("message_id")).limit(limit)
    return out.orderBy(F.col("date").desc(), F.col("message_id")) if ordered else out


def features_missing_embeddings(features: DataFrame, limit: int | None = None) -> DataFrame:
    """Feature rows without an embedding: all of them, or the first
    ``limit`` by message_id."""
    out = features.filter(F.col("subject_embedding").isNull())
    return out.orderBy("message_id").limit(limit) if limit else out


def label_candidates(
    emails: DataFrame, features: DataFrame, semantic_labels: DataFrame | None, limit: int | None = None
) -> DataFrame:
    """Mail with features and without a semantic label yet: all of it, or
    the newest ``limit``."""
    c = emails.join(features.select("message_id"), "message_id", "left_semi")
    if semantic_labels is not None:
        c = c.join(semantic_labels.select("message_id"), "message_id", "left_anti")
    return c.orderBy(F.col("date").desc(), F.col("message_id")).limit(limit) if limit else c


def semantic_training_set(semantic_labels: DataFrame, features: DataFrame) -> DataFrame:
    """(label, subject_embedding) per labelled mail with an embedding;
    several labels per mail are all kept."""
    f = features.filter(F.col("subject_embedding").isNotNull()).select("message_id", "subject_embedding")
    return semantic_labels.select("semantic_id", "message_id", "label").join(f, "message_id", "inner")


def label_support(training: DataFrame, min_samples: int = 3) -> DataFrame:
    """Per label sample counts, keeping labels with at least ``min_samples``."""
    return training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_samples)


def supported_training_set(training: DataFrame, min_samples: int = 3, min_rows: int = 10) -> DataFrame:
    """Rows of supported labels; raises if fewer than ``min_rows`` remain."""
    keep = label_support(training, min_samples).select("label")
    out = training.join(keep, "label", "left_semi")
    n = out.count()
    if n < min_rows:
        raise ValueError(f"Not enough training data. Need at least {min_rows} samples, got {n}")
    return out


def table_counts(emails: DataFrame, actions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Row counts of the mail tables (email_labels = one row per mail label)."""
    n_labels = emails.select(F.coalesce(F.sum(F.size("labels")), F.lit(0)).alias("n")).scalar()
    return emails.agg(F.count(F.lit(1)).alias("emails")).select(
        "emails",
        n_labels.cast("bigint").alias("email_labels"),
        actions.select(F.count(F.lit(1))).scalar().alias("actions"),
        feedback.select(F.count(F.lit(1))).scalar().alias("feedback"),
    )


def feature_stats(emails: DataFrame, features: DataFrame) -> DataFrame:
    total = emails.select(F.count(F.lit(1))).scalar()
    agg = features.agg(
        F.count(F.lit(1)).alias("features_count"),
        F.avg("sender_open_rate").alias("s"),
        F.avg("domain_open_rate").alias("d"),
        F.count_if(F.col("is_newsletter")).alias("newsletter_count"),
    )
    return agg.select(
        total.alias("total_emails"),
        "features_count",
        F.when(total > 0, F.col("features_count") / total * 100).otherwise(F.lit(0.0)).alias("coverage_pct"),
        F.coalesce("s", F.lit(0.0)).alias("avg_sender_open_rate"),
        F.coalesce("d", F.lit(0.0)).alias("avg_domain_open_rate"),
        "newsletter_count",
        F.when(F.col("features_count") > 0, F.col("newsletter_count") / F.col("features_count") * 100)
        .otherwise(F.lit(0.0))
        .alias("newsletter_pct"),
    )
