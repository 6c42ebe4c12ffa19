"""Registered queries: filters, projections, lookups and limits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import oracles as O
from ..functions import columns as C
from ..operators import lookups as L
from ..sources import bridge as B
from .catalog import register
from .q_features import FEATURES_CTE, stored_features, BUILT_CTE, built_features

EMAIL_COLS = ["message_id", "from_address", "subject", "date", "was_read"]
_EC = ", ".join(EMAIL_COLS)


def _emails(spark, sf_dir) -> DataFrame:
    return B.emails(spark, sf_dir)


@register("email_by_id", O.with_tables(f"SELECT {_EC} FROM emails WHERE message_id = 'm42'", "emails"))
def email_by_id_q(spark, sf_dir):
    return L.email_by_id(_emails(spark, sf_dir), "m42").select(*EMAIL_COLS)


@register(
    "emails_by_ids",
    O.with_tables(
        f"SELECT {_EC} FROM emails WHERE message_id IN (SELECT message_id FROM email_actions WHERE source = 'correction')",
        "email_actions",
        "emails",
    ),
)
def emails_by_ids_q(spark, sf_dir):
    ids = B.email_actions(spark, sf_dir).filter(F.col("source") == "correction").select("message_id")
    return L.emails_by_ids(_emails(spark, sf_dir), ids).select(*EMAIL_COLS)


@register(
    "list_emails",
    O.with_tables(f"SELECT {_EC} FROM emails ORDER BY date DESC, message_id LIMIT 50 OFFSET 10", "emails"),
)
def list_emails_q(spark, sf_dir):
    return L.list_emails(_emails(spark, sf_dir), limit=50, offset=10).select(*EMAIL_COLS)


@register(
    "emails_by_sender",
    O.with_tables(
        f"SELECT {_EC} FROM emails WHERE from_address = 'src3@news.org' ORDER BY date DESC, message_id LIMIT 20", "emails"
    ),
)
def emails_by_sender_q(spark, sf_dir):
    return L.emails_by_sender(_emails(spark, sf_dir), "src3@news.org", limit=20).select(*EMAIL_COLS)


@register(
    "unread_emails",
    O.with_tables(f"SELECT {_EC} FROM emails WHERE was_read IS FALSE ORDER BY date DESC, message_id LIMIT 100", "emails"),
)
def unread_emails_q(spark, sf_dir):
    return L.unread_emails(_emails(spark, sf_dir), limit=100).select(*EMAIL_COLS)


@register(
    "emails_in_range",
    O.with_tables(
        f"SELECT {_EC} FROM emails WHERE date BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'",
        "emails",
    ),
)
def emails_in_range_q(spark, sf_dir):
    return L.emails_in_range(_emails(spark, sf_dir), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)).select(*EMAIL_COLS)


@register("count_emails", O.with_tables("SELECT CAST(count(*) AS BIGINT) AS n_emails FROM emails", "emails"))
def count_emails_q(spark, sf_dir):
    return L.count_emails(_emails(spark, sf_dir))


@register(
    "actions_for_email",
    O.with_tables(
        "SELECT action_id, message_id, action_type, source, timestamp FROM email_actions WHERE message_id = 'm42'",
        "email_actions",
    ),
)
def actions_for_email_q(spark, sf_dir):
    return L.actions_for_email(B.email_actions(spark, sf_dir), "m42").select(
        "action_id", "message_id", "action_type", "source", "timestamp"
    )


@register(
    "user_labels",
    O.with_tables(
        "SELECT message_id, list_filter(labels, lambda x: x NOT IN ('INBOX','UNREAD','IMPORTANT','STARRED','SENT','DRAFT',"
        "'TRASH','SPAM') AND NOT starts_with(x, 'Bot/')) AS user_labels FROM emails",
        "emails",
    ),
)
def user_labels_q(spark, sf_dir):
    return _emails(spark, sf_dir).select("message_id", C.user_labels("labels").alias("user_labels"))


@register(
    "bot_labels",
    O.with_tables("SELECT message_id, list_filter(labels, lambda x: starts_with(x, 'Bot/')) AS bot_labels FROM emails", "emails"),
)
def bot_labels_q(spark, sf_dir):
    return _emails(spark, sf_dir).select("message_id", C.bot_labels("labels").alias("bot_labels"))


FEATURE_COLS = [
    "message_id",
    "sender_domain",
    "sender_email_count",
    "is_newsletter",
    "subject_length",
    "body_length",
    "day_of_week",
    "hour_of_day",
    "computed_at",
]
_FC = ", ".join(FEATURE_COLS)
_FEAT = ("emails", "feature_embeddings")


@register(
    "features_by_id",
    O.with_tables(f"SELECT {_FC} FROM email_features WHERE message_id = 'm2'", *_FEAT, extra=[FEATURES_CTE]),
)
def features_by_id_q(spark, sf_dir):
    return L.features_by_id(stored_features(spark, sf_dir), "m2").select(*FEATURE_COLS)


@register(
    "has_features",
    O.with_tables(
        "SELECT e.message_id, EXISTS (SELECT 1 FROM email_features f WHERE f.message_id = e.message_id) AS has_features "
        "FROM emails e",
        *_FEAT,
        extra=[BUILT_CTE],
    ),
)
def has_features_q(spark, sf_dir):
    """Batch form: the membership flag for every mail."""
    return L.has_features_each(_emails(spark, sf_dir), built_features(spark, sf_dir))


@register(
    "count_features",
    O.with_tables("SELECT CAST(count(*) AS BIGINT) AS n_features FROM email_features", *_FEAT, extra=[FEATURES_CTE]),
)
def count_features_q(spark, sf_dir):
    return L.count_features(stored_features(spark, sf_dir))


@register(
    "features_for_ids",
    O.with_tables(
        "SELECT r.pos, r.message_id, f.sender_email_count, f.is_newsletter FROM "
        "(SELECT action_id AS pos, message_id FROM email_actions WHERE action_type = 'keep') r "
        "LEFT JOIN email_features f ON f.message_id = r.message_id",
        "email_actions",
        *_FEAT,
        extra=[FEATURES_CTE],
    ),
)
def features_for_ids_q(spark, sf_dir):
    """Requested ids = the mails of 'keep' actions, in action order."""
    ids = B.email_actions(spark, sf_dir).filter(F.col("action_type") == "keep").select(
        F.col("action_id").alias("pos"), "message_id"
    )
    out = L.features_for_ids(stored_features(spark, sf_dir), ids)
    return out.select("pos", "message_id", "sender_email_count", "is_newsletter")


@register(
    "list_features",
    O.with_tables(
        f"SELECT {_FC} FROM email_features ORDER BY computed_at DESC, message_id LIMIT 25 OFFSET 5",
        *_FEAT,
        extra=[FEATURES_CTE],
    ),
)
def list_features_q(spark, sf_dir):
    return L.list_features(stored_features(spark, sf_dir), limit=25, offset=5).select(*FEATURE_COLS)


@register(
    "unused_feedback",
    O.with_tables(
        "SELECT message_id, decision_correct, label_correct, correct_decision, correct_label, user_comment "
        "FROM feedback_reviews WHERE used_in_training IS FALSE",
        "feedback_reviews",
    ),
)
def unused_feedback_q(spark, sf_dir):
    return L.unused_feedback(B.feedback_reviews(spark, sf_dir))


@register(
    "label_prompts",
    O.with_tables(
        "SELECT message_id, coalesce(nullif(from_name, ''), from_address) AS sender, "
        "coalesce(nullif(subject, ''), '(no subject)') AS subject, substr(coalesce(snippet, ''), 1, 200) AS snippet "
        "FROM emails",
        "emails",
    ),
)
def label_prompts_q(spark, sf_dir):
    return L.label_prompts(_emails(spark, sf_dir))


@register(
    "review_snippet",
    O.with_tables(
        "SELECT message_id, CASE WHEN snippet IS NULL OR snippet = '' THEN 'N/A' ELSE "
        "replace(replace(replace(replace(replace(replace(replace(substr(snippet, 1, 100), '&lt;', '<'), '&gt;', '>'), "
        "'&quot;', '\"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') END AS snippet FROM emails",
        "emails",
    ),
)
def review_snippet_q(spark, sf_dir):
    return _emails(spark, sf_dir).select("message_id", C.review_snippet("snippet").alias("snippet"))
