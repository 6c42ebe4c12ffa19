"""Registered queries: evaluation operators over the fixed scorer.

The scored set is every mail: y = was_read, score = the fixed
integer-arithmetic score (many ties, so tie handling is exercised).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import oracles as O
from ..operators import decisions as D
from ..operators import evaluation as EV
from ..operators import ml as ML
from ..session import scratch_path
from ..sources import bridge as B
from .catalog import SQL_DOC_SCORE, doc_score, r6, register

SCORED_CTE = f"""
scored AS (
  SELECT message_id, CAST(was_read AS INTEGER) AS y, {SQL_DOC_SCORE.format(m='message_id')} AS score FROM emails
)"""


def scored(spark, sf_dir) -> DataFrame:
    em = B.emails(spark, sf_dir)
    return em.select("message_id", F.col("was_read").cast("int").alias("y"), doc_score(F.col("message_id")).alias("score"))


def _round_all(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _ev(body: str) -> str:
    return O.with_tables(body, "emails", extra=[SCORED_CTE])


AUC_SQL = """(SELECT (sum(CASE WHEN y = 1 THEN r END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
                 / (count_if(y = 1) * count_if(y = 0))
          FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored))"""


def _counts_sql(t: str) -> str:
    return (
        f"count_if(score >= {t} AND y = 1) AS tp, count_if(score >= {t} AND y = 0) AS fp, "
        f"count_if(score < {t} AND y = 0) AS tn, count_if(score < {t} AND y = 1) AS fn"
    )


_RATES = """
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall"""
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END"


@register(
    "threshold_metrics",
    _ev(
        f"""SELECT 0.5::DOUBLE AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round({_F1}, 6) AS f1, tp, fp, tn, fn
FROM (SELECT *, {_RATES} FROM (SELECT {_counts_sql('0.5')} FROM scored))"""
    ),
)
def threshold_metrics_q(spark, sf_dir):
    return _round_all(EV.threshold_metrics(scored(spark, sf_dir), 0.5))


@register(
    "evaluate",
    _ev(
        f"""SELECT round({AUC_SQL}, 6) AS auc, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round({_F1}, 6) AS f1, 0.5::DOUBLE AS threshold, n_samples, round(positive_rate, 6) AS positive_rate,
       tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
       round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 6) AS false_positive_rate
FROM (SELECT *, {_RATES} FROM (SELECT {_counts_sql('0.5')}, count(*) AS n_samples, avg(y) AS positive_rate FROM scored))"""
    ),
)
def evaluate_q(spark, sf_dir):
    return _round_all(EV.evaluate(scored(spark, sf_dir), 0.5))


def _sweep_sql(lo: int, hi: int, div: int) -> str:
    return f"""
SELECT t.threshold,
  count_if(s.score >= t.threshold AND s.y = 1) AS tp, count_if(s.score >= t.threshold AND s.y = 0) AS fp,
  count_if(s.score < t.threshold AND s.y = 0) AS tn, count_if(s.score < t.threshold AND s.y = 1) AS fn,
  count(*) AS n_samples, avg(s.y) AS positive_rate
FROM (SELECT CAST(i AS DOUBLE) / {div} AS threshold FROM range({lo}, {hi}) r(i)) t, scored s
GROUP BY t.threshold"""


@register(
    "threshold_sweep",
    _ev(
        f"""SELECT threshold, tp, fp, tn, fn, n_samples, round(positive_rate, 6) AS positive_rate,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1,
       round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 6) AS false_positive_rate,
       round({AUC_SQL}, 6) AS auc
FROM (SELECT *, {_RATES} FROM ({_sweep_sql(1, 10, 10)}))"""
    ),
)
def threshold_sweep_q(spark, sf_dir):
    return _round_all(EV.threshold_sweep(scored(spark, sf_dir)))


@register(
    "optimal_threshold",
    _ev(
        f"""SELECT threshold, tp, fp, tn, fn, n_samples, round(positive_rate, 6) AS positive_rate,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 6) AS false_positive_rate, false AS fallback
FROM (SELECT *, {_F1} AS f1 FROM (SELECT *, {_RATES} FROM ({_sweep_sql(1, 100, 100)})))
ORDER BY f1 DESC, threshold ASC LIMIT 1"""
    ),
)
def optimal_threshold_q(spark, sf_dir):
    return _round_all(EV.optimal_threshold(scored(spark, sf_dir)))


@register(
    "archive_precision",
    _ev(
        """SELECT t AS archive_threshold,
       round(CASE WHEN n > 0 THEN c / n ELSE 0.0 END, 6) AS archive_precision, n AS n_archived,
       f AS n_false_positives, round(CASE WHEN n > 0 THEN f / n ELSE 0.0 END, 6) AS false_positive_rate
FROM (SELECT t.t, count_if(s.score < t.t) AS n, count_if(s.score < t.t AND s.y = 0) AS c,
             count_if(s.score < t.t AND s.y = 1) AS f
      FROM (VALUES (0.2::DOUBLE), (0.25::DOUBLE), (0.3::DOUBLE), (0.35::DOUBLE)) t(t), scored s GROUP BY t.t)"""
    ),
)
def archive_precision_q(spark, sf_dir):
    return _round_all(EV.archive_precision(scored(spark, sf_dir)))


_CURVE_SQL = """
hist AS (SELECT score, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scored GROUP BY score),
curve AS (
  SELECT score, pos, neg,
         sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps,
         lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg,
         row_number() OVER (ORDER BY score DESC) AS k
  FROM hist
)"""


@register(
    "roc_curve",
    O.with_tables(
        """SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT score, round(fps / (SELECT sum(neg) FROM hist), 6), round(tps / (SELECT sum(pos) FROM hist), 6)
FROM curve WHERE k = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
        "emails",
        extra=[SCORED_CTE, _CURVE_SQL],
    ),
)
def roc_curve_q(spark, sf_dir):
    return _round_all(EV.roc_curve(scored(spark, sf_dir)))


@register(
    "pr_curve",
    O.with_tables(
        """SELECT score AS threshold, round(CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0 END, 6) AS precision,
       round(tps / (SELECT sum(pos) FROM hist), 6) AS recall FROM curve
UNION ALL SELECT NULL, 1.0, 0.0""",
        "emails",
        extra=[SCORED_CTE, _CURVE_SQL],
    ),
)
def pr_curve_q(spark, sf_dir):
    return _round_all(EV.pr_curve(scored(spark, sf_dir)))


@register(
    "score_summary",
    _ev(
        """SELECT count(*) AS n, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score,
       round(max(score), 6) AS max_score, count_if(score >= 0.7) AS high_keep, count_if(score <= 0.3) AS high_archive,
       count_if(score > 0.3 AND score < 0.7) AS low_confidence,
       round(count_if((score >= 0.5 AND y = 1) OR (score < 0.5 AND y = 0)) / count(*), 6) AS accuracy
FROM scored"""
    ),
)
def score_summary_q(spark, sf_dir):
    return _round_all(EV.score_summary(scored(spark, sf_dir)))


@register(
    "auc",
    _ev(f"SELECT round({AUC_SQL}, 6) AS auc"),
)
def auc_q(spark, sf_dir):
    return _round_all(EV.auc(scored(spark, sf_dir)))


_PRED_CTE = """
preds AS (
  SELECT concat('Label-', e.label) AS label, concat('Label-', n.label) AS prediction
  FROM embeddings e JOIN embeddings n ON n.vec_id = e.vec_id + 1
)"""


@register(
    "classification_report",
    O.with_tables(
        """WITH_PLACEHOLDER""",
    ).replace(
        "WITH_PLACEHOLDER",
        "WITH " + _PRED_CTE + """,
cls AS (SELECT label AS c FROM preds UNION SELECT prediction FROM preds),
per AS (
  SELECT c AS label,
    CASE WHEN (SELECT count(*) FROM preds WHERE prediction = c) > 0
         THEN (SELECT count(*) FROM preds WHERE prediction = c AND label = c) / (SELECT count(*) FROM preds WHERE prediction = c)
         ELSE 0.0 END AS precision,
    CASE WHEN (SELECT count(*) FROM preds WHERE label = c) > 0
         THEN (SELECT count(*) FROM preds WHERE prediction = c AND label = c) / (SELECT count(*) FROM preds WHERE label = c)
         ELSE 0.0 END AS recall,
    (SELECT count(*) FROM preds WHERE label = c) AS support
  FROM cls
),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, support, round(f1, 6) AS f1 FROM per2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), CAST(sum(support) AS BIGINT), round(avg(f1), 6) FROM per2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT), round(sum(f1 * support) / sum(support), 6) FROM per2""",
    ),
)
def classification_report_q(spark, sf_dir):
    emb = B.embeddings(spark, sf_dir)
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("plabel"))
    preds = emb.join(nxt, "vec_id").select(
        F.concat(F.lit("Label-"), F.col("label").cast("string")).alias("label"),
        F.concat(F.lit("Label-"), F.col("plabel").cast("string")).alias("prediction"),
    )
    rep = EV.classification_report(preds)
    return _round_all(rep.select("label", "precision", "recall", F.col("support").cast("bigint").alias("support"), "f1"))


@register(
    "reasoning_text",
    _ev(
        """SELECT message_id, CASE
  WHEN score >= 0.7 THEN 'High likelihood of reading (score: ' || printf('%.3f', score) || ')'
  WHEN score <= 0.3 THEN 'Low likelihood of reading (score: ' || printf('%.3f', score) || ')'
  ELSE 'Uncertain prediction (score: ' || printf('%.3f', score) || '), keeping to be safe' END AS reasoning
FROM scored"""
    ),
)
def reasoning_text_q(spark, sf_dir):
    d = D.decide(scored(spark, sf_dir))
    return d.select("message_id", D.reasoning(F.col("score"), F.col("action"), F.col("confidence")).alias("reasoning"))


@register(
    "metrics_round_trip",
    _ev(
        f"""SELECT round({AUC_SQL}, 6) AS auc, round(precision, 6) AS precision, round(recall, 6) AS recall, n_samples
FROM (SELECT *, {_RATES} FROM (SELECT {_counts_sql('0.5')}, count(*) AS n_samples FROM scored))"""
    ),
)
def metrics_round_trip_q(spark, sf_dir):
    """Metrics as saved and loaded again."""
    path = scratch_path(spark, f"metrics-{uuid.uuid4().hex[:12]}")
    ML.save_metrics(EV.evaluate(scored(spark, sf_dir), 0.5), path)
    return _round_all(ML.load_metrics(spark, path).select("auc", "precision", "recall", "n_samples"))
