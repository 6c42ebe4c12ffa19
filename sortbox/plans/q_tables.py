"""Registered queries: joins, table aggregates, text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracles as O
from ..functions import columns as C
from ..operators import joins as J
from ..operators import lookups as L
from ..operators.feedback import apply_corrections
from ..sources import bridge as B
from .catalog import r6, register
from .q_feedback import _CORR_SQL, AS_OF
from .q_features import FEATURES_CTE, stored_features, BUILT_CTE, built_features

_FEAT = ("emails", "feature_embeddings")


@register(
    "emails_with_features",
    O.with_tables(
        "SELECT e.message_id, e.was_read, f.sender_email_count FROM emails e JOIN email_features f "
        "ON f.message_id = e.message_id WHERE f.sender_email_count >= 2",
        *_FEAT,
        extra=[FEATURES_CTE],
    ),
)
def emails_with_features_q(spark, sf_dir):
    j = J.emails_with_features(B.emails(spark, sf_dir), stored_features(spark, sf_dir))
    return j.select("message_id", "was_read", "sender_email_count")


@register(
    "emails_without_features",
    O.with_tables(
        "SELECT e.message_id, e.date FROM emails e LEFT JOIN email_features f ON f.message_id = e.message_id "
        "WHERE f.message_id IS NULL ORDER BY e.date DESC, e.message_id LIMIT 100",
        *_FEAT,
        extra=[BUILT_CTE],
    ),
)
def emails_without_features_q(spark, sf_dir):
    return J.emails_without_features(B.emails(spark, sf_dir), built_features(spark, sf_dir), 100).select("message_id", "date")


@register(
    "features_missing_embeddings",
    O.with_tables(
        "SELECT message_id FROM email_features WHERE subject_embedding IS NULL ",
        *_FEAT,
        extra=[FEATURES_CTE],
    ),
)
def features_missing_embeddings_q(spark, sf_dir):
    return J.features_missing_embeddings(stored_features(spark, sf_dir)).select("message_id")


@register(
    "label_candidates",
    O.with_tables(
        "SELECT e.message_id, e.date FROM emails e WHERE e.message_id IN (SELECT message_id FROM email_features) "
        "AND e.message_id NOT IN (SELECT message_id FROM semantic_labels)",
        *_FEAT,
        "semantic_labels",
        extra=[FEATURES_CTE],
    ),
)
def label_candidates_q(spark, sf_dir):
    c = J.label_candidates(B.emails(spark, sf_dir), stored_features(spark, sf_dir), B.semantic_labels(spark, sf_dir))
    return c.select("message_id", "date")


@register(
    "semantic_training_set",
    O.with_tables(
        "SELECT s.semantic_id, s.message_id, s.label, CAST(len(f.subject_embedding) AS INTEGER) AS dims "
        "FROM semantic_labels s JOIN email_features f ON f.message_id = s.message_id WHERE f.subject_embedding IS NOT NULL",
        *_FEAT,
        "semantic_labels",
        extra=[FEATURES_CTE],
    ),
)
def semantic_training_set_q(spark, sf_dir):
    t = J.semantic_training_set(B.semantic_labels(spark, sf_dir), stored_features(spark, sf_dir))
    return t.select("semantic_id", "message_id", "label", F.size("subject_embedding").alias("dims"))


@register(
    "label_support",
    O.with_tables(
        "SELECT s.label, count(*) AS n FROM semantic_labels s JOIN email_features f ON f.message_id = s.message_id "
        "WHERE f.subject_embedding IS NOT NULL GROUP BY s.label HAVING count(*) >= 3",
        *_FEAT,
        "semantic_labels",
        extra=[FEATURES_CTE],
    ),
)
def label_support_q(spark, sf_dir):
    t = J.semantic_training_set(B.semantic_labels(spark, sf_dir), stored_features(spark, sf_dir))
    return J.label_support(t)


@register(
    "table_counts",
    O.with_tables(
        "SELECT (SELECT count(*) FROM emails) AS emails, (SELECT CAST(coalesce(sum(len(labels)), 0) AS BIGINT) FROM emails) "
        "AS email_labels, (SELECT count(*) FROM email_actions) AS actions, (SELECT count(*) FROM feedback_reviews) AS feedback",
        "emails",
        "email_actions",
        "feedback_reviews",
    ),
)
def table_counts_q(spark, sf_dir):
    return J.table_counts(B.emails(spark, sf_dir), B.email_actions(spark, sf_dir), B.feedback_reviews(spark, sf_dir))


@register(
    "feature_stats",
    O.with_tables(
        """SELECT t AS total_emails, n AS features_count, round(CASE WHEN t > 0 THEN n / t * 100 ELSE 0.0 END, 6) AS coverage_pct,
  round(coalesce(s, 0.0), 6) AS avg_sender_open_rate, round(coalesce(d, 0.0), 6) AS avg_domain_open_rate,
  nl AS newsletter_count, round(CASE WHEN n > 0 THEN nl / n * 100 ELSE 0.0 END, 6) AS newsletter_pct
FROM (SELECT (SELECT count(*) FROM emails) AS t, count(*) AS n, avg(sender_open_rate) AS s, avg(domain_open_rate) AS d,
             count_if(is_newsletter) AS nl FROM email_features)""",
        *_FEAT,
        extra=[BUILT_CTE],
    ),
)
def feature_stats_q(spark, sf_dir):
    s = J.feature_stats(B.emails(spark, sf_dir), built_features(spark, sf_dir))
    return s.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


_MAPPINGS_ALL = f"""
{_CORR_SQL.strip()},
learned AS (SELECT max_by(primary_label, review_id) AS label FROM plan WHERE fix AND NOT already_applied GROUP BY from_address),
all_mappings AS (SELECT label FROM sender_label_mappings UNION ALL SELECT label FROM learned)"""


def _all_mapping_labels(spark, sf_dir):
    e, a, f = B.emails(spark, sf_dir), B.email_actions(spark, sf_dir), B.feedback_reviews(spark, sf_dir)
    learned = apply_corrections(f, e, a, AS_OF)["mappings"].select("label")
    return B.sender_label_mappings(spark).select("label").unionByName(learned)


@register(
    "custom_labels",
    O.with_tables(
        "SELECT DISTINCT label FROM all_mappings",
        "emails", "email_actions", "feedback_reviews", "sender_label_mappings",
        extra=[_MAPPINGS_ALL],
    ),
)
def custom_labels_q(spark, sf_dir):
    """Distinct labels of the seed mappings plus those learned from feedback."""
    return L.custom_labels(_all_mapping_labels(spark, sf_dir))


_BUILT = "[" + ", ".join(f"'{c}'" for c in L.BUILT_IN_CATEGORIES) + "]"


@register(
    "all_categories",
    O.with_tables(
        f"SELECT unnest({_BUILT}) AS label, true AS built_in UNION ALL "
        f"SELECT DISTINCT label, false FROM all_mappings WHERE NOT list_contains({_BUILT}, label)",
        "emails", "email_actions", "feedback_reviews", "sender_label_mappings",
        extra=[_MAPPINGS_ALL],
    ),
)
def all_categories_q(spark, sf_dir):
    return L.all_categories(spark, _all_mapping_labels(spark, sf_dir))


@register(
    "prepare_text",
    O.with_tables(
        "SELECT message_id, trim(regexp_replace(coalesce(body_plain, ''), '\\s+', ' ', 'g')) AS text, "
        "substr(trim(regexp_replace(coalesce(body_plain, ''), '\\s+', ' ', 'g')), 1, 2048) AS cut FROM emails",
        "emails",
    ),
)
def prepare_text_q(spark, sf_dir):
    em = B.emails(spark, sf_dir)
    body = F.coalesce("body_plain", F.lit(""))
    return em.select("message_id", C.prepare_text(body).alias("text"), C.prepare_text(body, C.TEXT_MAX_CHARS).alias("cut"))


@register(
    "body_source",
    O.with_tables(
        "SELECT message_id, md5(coalesce(nullif(body_plain, ''), nullif(snippet, ''), '')) AS body_md5 FROM emails", "emails"
    ),
)
def body_source_q(spark, sf_dir):
    em = B.emails(spark, sf_dir)
    return em.select("message_id", F.md5(C.body_source("body_plain", "snippet")).alias("body_md5"))
