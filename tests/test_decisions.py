"""Decisions, reasoning text and triage labels."""

import math

from pyspark.sql import functions as F

from sortbox.operators import decisions as D
from sortbox.operators import labels as LB


def test_decide_thresholds_and_nan(spark):
    df = spark.createDataFrame([(0.7,), (0.3,), (0.5,), (math.nan,), (None,), (0.95,)], "score double")
    got = [(r.action, r.confidence) for r in D.decide(df).collect()]
    assert got == [("keep", "high"), ("archive", "high"), ("keep", "low"), ("keep", "low"), ("keep", "low"), ("keep", "high")]


def test_reasoning_text(spark):
    df = spark.createDataFrame([(0.8123,), (0.1,), (0.5,)], "score double")
    d = D.decide(df)
    got = [r.t for r in d.select(D.reasoning(F.col("score"), F.col("action"), F.col("confidence")).alias("t")).collect()]
    assert got == [
        "High likelihood of reading (score: 0.812)",
        "Low likelihood of reading (score: 0.100)",
        "Uncertain prediction (score: 0.500), keeping to be safe",
    ]


def test_triage_summary_and_shares(spark):
    df = D.decide(spark.createDataFrame([(0.9,), (0.1,), (0.5,), (0.2,)], "score double"))
    s = D.triage_summary(df).first()
    assert (s.total, s.high_keep, s.high_archive, s.low_confidence, s.errors) == (4, 1, 2, 1, 0)
    empty = D.triage_shares(D.triage_summary(df.limit(0))).first()
    assert empty.total == 0 and empty.high_keep_pct is None


def test_triage_labels(spark):
    sug = lambda lab, k: LB.suggestion(F.lit(lab), k, 0.5, "r")
    df = spark.range(1).select(F.array(sug("Bot/A", 2), sug("Bot/B", 3)).alias("s"))
    r = df.select(
        LB.triage_labels(F.col("s"), F.lit("archive"), F.lit("low")).alias("x"),
        LB.primary_label(F.col("s")).alias("p"),
        LB.max_labels(F.col("s"), 1).alias("m"),
    ).first()
    assert r.x == ["Bot/A", "Bot/B", "Bot/LowConfidence", "Bot/AutoArchived"]
    assert r.p == "Bot/A" and r.m == ["Bot/A"]
