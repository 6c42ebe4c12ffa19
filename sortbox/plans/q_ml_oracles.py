"""Oracles for the embedding keys: which mail gets a vector and of what
size is deterministic even though the vector values come from an encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracles as O
from .catalog import register
from .q_features import FEATURES_CTE
from .q_ml import embed_text_q, embedding_backlog_q


def _null_size(df, c):
    # size() of a NULL array is -1 under legacy settings and NULL otherwise
    return df.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))


@register(
    "embed_text",
    O.with_tables(
        "SELECT message_id, CASE WHEN trim(coalesce(subject, '')) <> '' THEN 384 END::INTEGER AS dims FROM emails", "emails"
    ),
)
def embed_text_checked(spark, sf_dir):
    """Subjects encoded (hashing encoder, 384 slots); blank -> NULL."""
    return _null_size(embed_text_q(spark, sf_dir), "dims")


@register(
    "embedding_backlog",
    O.with_tables(
        """SELECT f.message_id,
  CASE WHEN b.message_id IS NOT NULL THEN CASE WHEN trim(coalesce(e.subject, '')) <> '' THEN 64 END
       ELSE len(f.subject_embedding) END::INTEGER AS dims,
  CASE WHEN b.message_id IS NOT NULL
       THEN CASE WHEN trim(coalesce(nullif(e.body_plain, ''), nullif(e.snippet, ''), '')) <> '' THEN 64 END
       ELSE len(f.body_embedding) END::INTEGER AS body_dims,
  CASE WHEN b.message_id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE f.computed_at END AS computed_at
FROM email_features f JOIN emails e ON e.message_id = f.message_id
LEFT JOIN (SELECT message_id FROM email_features WHERE subject_embedding IS NULL) b
  ON b.message_id = f.message_id""",
        "emails",
        "feature_embeddings",
        extra=[FEATURES_CTE],
    ),
)
def embedding_backlog_checked(spark, sf_dir):
    """All feature rows without embeddings are encoded, subject and body."""
    return _null_size(_null_size(embedding_backlog_q(spark, sf_dir), "dims"), "body_dims")
