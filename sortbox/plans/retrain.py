"""The retrain job: full retrain on all data, then every unused feedback
row is marked as used (the feedback-only mode and sample weighting of the
application are not implemented there either: weights stay optional)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ml as ML


def mark_feedback_used(feedback: DataFrame) -> DataFrame:
    return feedback.withColumn("used_in_training", F.lit(True))


def retrain(emails: DataFrame, features: DataFrame, feedback: DataFrame, use_embeddings: bool = True) -> dict[str, DataFrame]:
    matrix = ML.training_matrix(emails, features, use_embeddings=use_embeddings)
    model, test, metrics = ML.train_importance_model(matrix)
    return {"model": model, "test": test, "metrics": metrics, "feedback": mark_feedback_used(feedback)}
