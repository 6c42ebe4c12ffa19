"""Registered queries: ML operators (matrix, split, models, embeddings).

Model outputs are checked by row counts only (R); deterministic parts
(matrix, embedding combination, split sizes, retrain flags) have oracles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import oracles as O
from ..operators import evaluation as EV
from ..operators import joins as J
from ..operators import ml as ML
from ..sources import bridge as B
from . import build_features as BF
from .catalog import r6, register
from .q_features import FEATURES_CTE, stored_features

_FEAT = ("emails", "feature_embeddings")


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register(
    "combine_embeddings",
    O.with_tables(
        """SELECT message_id, CASE
  WHEN len(subject_embedding) > 0 AND len(body_embedding) > 0 THEN
    list_transform(range(1, least(len(subject_embedding), len(body_embedding)) + 1),
                   lambda i: round((subject_embedding[i] + body_embedding[i]) / 2, 6))
  WHEN len(subject_embedding) > 0 THEN list_transform(subject_embedding, lambda x: round(x, 6))
  WHEN len(body_embedding) > 0 THEN list_transform(body_embedding, lambda x: round(x, 6)) END AS combined
FROM feature_embeddings""",
        *_FEAT,
    ),
)
def combine_embeddings_q(spark, sf_dir):
    fe = B.feature_embeddings(spark, sf_dir)
    c = ML.combine_embeddings(F.col("subject_embedding"), F.col("body_embedding"))
    return fe.select("message_id", F.transform(c, lambda x: F.round(x, 6)).alias("combined"))


def _matrix(spark, sf_dir, use_embeddings=True) -> DataFrame:
    return ML.training_matrix(B.emails(spark, sf_dir), stored_features(spark, sf_dir), use_embeddings=use_embeddings)


_MATRIX_SQL = """
SELECT e.message_id, CAST(e.was_read AS INTEGER) AS y,
  CAST(coalesce(CAST(f.is_newsletter AS DOUBLE), 0) AS DOUBLE) AS is_newsletter,
  CAST(coalesce(f.day_of_week, 0) AS DOUBLE) AS day_of_week, CAST(coalesce(f.hour_of_day, 0) AS DOUBLE) AS hour_of_day,
  CAST(coalesce(f.subject_length, 0) AS DOUBLE) AS subject_length, CAST(coalesce(f.body_length, 0) AS DOUBLE) AS body_length,
  CAST(coalesce(f.sender_email_count, 0) AS DOUBLE) AS sender_email_count, round(coalesce(f.sender_open_rate, 0), 6) AS sender_open_rate,
  round(coalesce(f.sender_days_since_last, 999.0), 6) AS sender_days_since_last,
  round(coalesce(f.domain_open_rate, 0), 6) AS domain_open_rate,
  CAST(greatest(coalesce(len(f.subject_embedding), 0), coalesce(len(f.body_embedding), 0)) AS INTEGER) AS emb_dims
FROM emails e JOIN email_features f ON f.message_id = e.message_id
WHERE f.sender_email_count >= 2
  AND (coalesce(len(f.subject_embedding), 0) > 0 OR coalesce(len(f.body_embedding), 0) > 0)"""


@register("training_matrix", O.with_tables(_MATRIX_SQL, *_FEAT, extra=[FEATURES_CTE]))
def training_matrix_q(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return _round(m.withColumn("emb_dims", F.size("emb")).drop("emb"))


@register(
    "training_matrix_no_embeddings",
    O.with_tables(
        """SELECT e.message_id, CAST(e.was_read AS INTEGER) AS y, round(coalesce(f.sender_days_since_last, 999.0), 6) AS days
FROM emails e JOIN email_features f ON f.message_id = e.message_id WHERE f.sender_email_count >= 2""",
        *_FEAT,
        extra=[FEATURES_CTE],
    ),
)
def training_matrix_no_emb_q(spark, sf_dir):
    m = _matrix(spark, sf_dir, use_embeddings=False)
    return _round(m.select("message_id", "y", F.col("sender_days_since_last").alias("days")))


@register(
    "stratified_split_counts",
    O.with_tables(
        """SELECT CAST(was_read AS INTEGER) AS y, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_test, CAST(count(*) AS BIGINT) AS n
FROM emails GROUP BY 1""",
        "emails",
    ),
)
def stratified_split_counts_q(spark, sf_dir):
    em = B.emails(spark, sf_dir).select("message_id", F.col("was_read").cast("int").alias("y"))
    s = ML.stratified_split(em, "y", 0.2)
    return s.groupBy("y").agg(F.count_if("is_test").cast("bigint").alias("n_test"), F.count(F.lit(1)).alias("n"))


@register(
    "stratified_split",
    O.with_tables(
        """SELECT message_id, CAST(was_read AS INTEGER) AS y,
  row_number() OVER (PARTITION BY was_read ORDER BY md5(message_id || ':42'), message_id)
    <= ceil(count(*) OVER (PARTITION BY was_read) * 0.2) AS is_test
FROM emails""",
        "emails",
    ),
)
def stratified_split_q(spark, sf_dir):
    em = B.emails(spark, sf_dir).select("message_id", F.col("was_read").cast("int").alias("y"))
    return ML.stratified_split(em, "y", 0.2).select("message_id", "y", "is_test")


_FITTED: dict[tuple[str, str, str], tuple] = {}


def _once(kind: str, spark, sf_dir, fit):
    """Models are fitted once per application; several queries use each."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def _trained(spark, sf_dir):
    return _once("importance", spark, sf_dir, lambda: ML.train_importance_model(_matrix(spark, sf_dir)))


@register("train_importance_model")
def train_importance_model_q(spark, sf_dir):
    _, _, metrics = _trained(spark, sf_dir)
    return metrics


@register("score_emails")
def score_emails_q(spark, sf_dir):
    """Every feature row is scored, also those the training filter leaves out."""
    model, _, _ = _trained(spark, sf_dir)
    return ML.score_emails(model, stored_features(spark, sf_dir), ML.embedding_width(_matrix(spark, sf_dir)))


@register(
    "model_round_trip",
    O.with_tables("SELECT count(*) AS n, count(*) AS n_equal FROM email_features", *_FEAT, extra=[FEATURES_CTE]),
)
def model_round_trip_q(spark, sf_dir):
    """A saved and loaded model scores every row as before."""
    import uuid

    from ..session import scratch_path

    model, matrix = _trained(spark, sf_dir)[0], _matrix(spark, sf_dir)
    base, names = scratch_path(spark, f"models-{uuid.uuid4().hex[:12]}"), ML.feature_columns(matrix)
    ML.save_model(model, base, "v1", names)
    loaded, stored_names = ML.load_model(spark, base)
    assert stored_names == names
    feats, dims = stored_features(spark, sf_dir), ML.embedding_width(matrix)
    again = ML.score_emails(loaded, feats, dims).withColumnRenamed("score", "again")
    both = ML.score_emails(model, feats, dims).join(again, "message_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == F.col("again")).alias("n_equal"))


@register("feature_importance")
def feature_importance_q(spark, sf_dir):
    model, _, _ = _trained(spark, sf_dir)
    return ML.feature_importance(spark, model, ML.feature_columns(_matrix(spark, sf_dir)), top_n=20)


@register("train_report")
def train_report_q(spark, sf_dir):
    """Archive precision at the script's thresholds, the keep threshold (best
    recall with precision >= 0.7) and the recommended archive threshold on
    the model's test predictions, and the features by importance."""
    model, test, _ = _trained(spark, sf_dir)
    names = ML.feature_columns(_matrix(spark, sf_dir))
    imp = ML.feature_importance(spark, model, names, top_n=20)
    weights = imp.select(F.concat(F.lit("importance:"), F.col("feature")).alias("kind"), F.lit(None).cast("double").alias("threshold"), F.col("importance").alias("value"))
    # The largest threshold that archives with a precision of 0.9 or more.
    good = EV.archive_precision(test).filter((F.col("archive_precision") >= 0.9) & (F.col("n_archived") > 0))
    best = good.groupBy().agg(F.max_by("archive_precision", "archive_threshold").alias("value"), F.max("archive_threshold").alias("threshold"))
    recommended = best.select(F.lit("recommended_archive").alias("kind"), "threshold", "value")
    ap = EV.archive_precision(test).select(F.lit("archive").alias("kind"), F.col("archive_threshold").alias("threshold"), F.col("archive_precision").alias("value"))
    keep = EV.optimal_threshold(test, "recall", 0.7).select(F.lit("keep").alias("kind"), "threshold", F.col("recall").alias("value"))
    return ap.unionByName(keep).unionByName(recommended).unionByName(weights)


def _leafwise(spark, sf_dir):
    return _once("leafwise", spark, sf_dir, lambda: ML.train_leafwise_model(_matrix(spark, sf_dir)))


@register("train_leafwise_model")
def train_leafwise_model_q(spark, sf_dir):
    """Best-first boosting with early stopping on the test AUC."""
    return _leafwise(spark, sf_dir)[2]


@register("score_emails_leafwise")
def score_emails_leafwise_q(spark, sf_dir):
    return ML.score_emails_leafwise(_leafwise(spark, sf_dir)[0], stored_features(spark, sf_dir))


@register("leafwise_importance")
def leafwise_importance_q(spark, sf_dir):
    return ML.leafwise_importance(spark, _leafwise(spark, sf_dir)[0])


@register(
    "leafwise_round_trip",
    O.with_tables("SELECT count(*) AS n, count(*) AS n_equal FROM email_features", *_FEAT, extra=[FEATURES_CTE]),
)
def leafwise_round_trip_q(spark, sf_dir):
    """A saved and loaded leaf-wise model scores every row as before."""
    import uuid

    from ..operators import boosting as BO
    from ..session import scratch_path

    model, feats = _leafwise(spark, sf_dir)[0], stored_features(spark, sf_dir)
    path = scratch_path(spark, f"models-{uuid.uuid4().hex[:12]}")
    BO.save(model, path, spark)
    again = ML.score_emails_leafwise(BO.load(spark, path), feats).withColumnRenamed("score", "again")
    both = ML.score_emails_leafwise(model, feats).join(again, "message_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == F.col("again")).alias("n_equal"))


def _semantic(spark, sf_dir):
    def fit():
        t = J.semantic_training_set(B.semantic_labels(spark, sf_dir), stored_features(spark, sf_dir))
        return ML.train_semantic_classifier(t.select("message_id", "label", "subject_embedding"))

    return _once("semantic", spark, sf_dir, fit)


@register("train_semantic_classifier")
def train_semantic_classifier_q(spark, sf_dir):
    return _semantic(spark, sf_dir)[2]


@register("semantic_report")
def semantic_report_q(spark, sf_dir):
    """Precision, recall and F1 of each label on the classifier's test rows."""
    test = _semantic(spark, sf_dir)[1]
    return _round(EV.classification_report(test, "label", "sem_label"))


@register("predict_semantic")
def predict_semantic_q(spark, sf_dir):
    model = _semantic(spark, sf_dir)[0]
    f = stored_features(spark, sf_dir).filter(F.col("subject_embedding").isNotNull())
    return ML.predict_semantic(model, f.select("message_id", "subject_embedding")).select("message_id", "sem_label", "sem_confidence")


@register("top_k_labels")
def top_k_labels_q(spark, sf_dir):
    model = _semantic(spark, sf_dir)[0]
    f = stored_features(spark, sf_dir).filter(F.col("subject_embedding").isNotNull())
    return ML.top_k_labels(model, f.select("message_id", "subject_embedding"), 3).select("message_id", "top_k")


@register("embed_text")
def embed_text_q(spark, sf_dir):
    """Subjects encoded by the JVM hashing encoder (no model offline)."""
    em = B.emails(spark, sf_dir).select("message_id", "subject")
    e = ML.embed_text(em, "subject", "subject_embedding", dims=384)
    return e.select("message_id", F.size("subject_embedding").alias("dims"))


@register("embedding_backlog")
def embedding_backlog_q(spark, sf_dir):
    """Feature rows without embeddings get them (hashing encoder)."""
    em = B.emails(spark, sf_dir)

    out = BF.build_features(
        em, stored_features(spark, sf_dir), dt.datetime(2024, 2, 1), embed=lambda df: ML.embed_mail(df, dims=64), embeddings_only=True
    )
    return out["table"].select("message_id", F.size("subject_embedding").alias("dims"), F.size("body_embedding").alias("body_dims"), "computed_at")


@register(
    "retrain_feedback_flags",
    O.with_tables("SELECT review_id, true AS used_in_training FROM feedback_reviews", "feedback_reviews"),
)
def retrain_feedback_flags_q(spark, sf_dir):
    """After a retrain every unused feedback row is marked used."""
    from ..plans.retrain import mark_feedback_used

    return mark_feedback_used(B.feedback_reviews(spark, sf_dir)).select("review_id", "used_in_training")


@register("retrain")
def retrain_q(spark, sf_dir):
    from ..plans.retrain import retrain

    r = retrain(B.emails(spark, sf_dir), stored_features(spark, sf_dir), B.feedback_reviews(spark, sf_dir))
    return r["metrics"]
