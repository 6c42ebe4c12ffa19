"""Score -> decision operators and triage counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH_CONFIDENCE_KEEP = 0.7
HIGH_CONFIDENCE_ARCHIVE = 0.3


def decide_columns(
    score: Column, keep_threshold: float = HIGH_CONFIDENCE_KEEP, archive_threshold: float = HIGH_CONFIDENCE_ARCHIVE
) -> tuple[Column, Column]:
    """(action, confidence).  NaN compares greater than everything in Spark
    SQL; the application's comparisons are false for NaN, so NaN (and NULL)
    land in keep/low."""
    ok = score.isNotNull() & ~F.isnan(score)
    action = F.when(ok & (score >= keep_threshold), F.lit("keep")).when(
        ok & (score <= archive_threshold), F.lit("archive")
    ).otherwise(F.lit("keep"))
    confidence = F.when(ok & ((score >= keep_threshold) | (score <= archive_threshold)), F.lit("high")).otherwise(
        F.lit("low")
    )
    return action, confidence


def reasoning(score: Column, action: Column, confidence: Column) -> Column:
    s = F.format_string("%.3f", score)
    return (
        F.when((action == "keep") & (confidence == "high"), F.concat(F.lit("High likelihood of reading (score: "), s, F.lit(")")))
        .when(action == "archive", F.concat(F.lit("Low likelihood of reading (score: "), s, F.lit(")")))
        .otherwise(F.concat(F.lit("Uncertain prediction (score: "), s, F.lit("), keeping to be safe")))
    )


def decide(
    scored: DataFrame,
    score_col: str = "score",
    keep_threshold: float = HIGH_CONFIDENCE_KEEP,
    archive_threshold: float = HIGH_CONFIDENCE_ARCHIVE,
) -> DataFrame:
    action, conf = decide_columns(F.col(score_col), keep_threshold, archive_threshold)
    return scored.withColumn("action", action).withColumn("confidence", conf)


def triage_summary(decisions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """total, high_keep, high_archive, low_confidence, errors (one row)."""
    agg = decisions.agg(
        F.count(F.lit(1)).alias("decided"),
        F.count_if((F.col("confidence") == "high") & (F.col("action") != "archive")).alias("high_keep"),
        F.count_if((F.col("confidence") == "high") & (F.col("action") == "archive")).alias("high_archive"),
        F.count_if(F.col("confidence") != "high").alias("low_confidence"),
    )
    if errors is None:
        n_err = F.lit(0).cast("bigint")
    else:
        n_err = errors.select(F.count(F.lit(1))).scalar()
    return agg.select(
        (F.col("decided") + n_err).alias("total"), "high_keep", "high_archive", "low_confidence", n_err.alias("errors")
    )


def triage_shares(summary: DataFrame) -> DataFrame:
    """Each bucket as a percentage of the total; NULL when total is 0."""
    pct = lambda c: F.try_divide(F.col(c) * F.lit(100.0), F.col("total"))
    return summary.select(
        "total",
        pct("high_keep").alias("high_keep_pct"),
        pct("high_archive").alias("high_archive_pct"),
        pct("low_confidence").alias("low_confidence_pct"),
    )
