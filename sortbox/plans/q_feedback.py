"""Registered queries: review queue, feedback collection, corrections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import oracles as O
from ..operators import feedback as FB
from ..sources import bridge as B
from .catalog import r6, register

AS_OF = dt.datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
SINCE_7_SQL = "TIMESTAMP '2024-01-24 00:00:00'"

_A = ("emails", "email_actions")
_AF = ("emails", "email_actions", "feedback_reviews")

SQL_JSON_SCORE = (
    "CASE WHEN json_type(action_json, '$.score') IN ('DOUBLE', 'UBIGINT', 'BIGINT') "
    "THEN CAST(json_extract(action_json, '$.score') AS DOUBLE) END"
)
SQL_BOT = "list_filter({x}, lambda l: starts_with(l, 'Bot/'))"


def _tables(spark, sf_dir):
    return B.emails(spark, sf_dir), B.email_actions(spark, sf_dir), B.feedback_reviews(spark, sf_dir)


PENDING_SQL = f"""
pending AS (
  SELECT * FROM email_actions a
  WHERE a.source = 'bot' AND a.timestamp >= {SINCE_7_SQL}
    AND a.message_id NOT IN (SELECT message_id FROM feedback_reviews)
)"""


@register(
    "pending_reviews",
    O.with_tables("SELECT action_id, message_id, action_type FROM pending", *_AF, extra=[PENDING_SQL]),
)
def pending_reviews_q(spark, sf_dir):
    _, a, f = _tables(spark, sf_dir)
    return FB.pending_reviews(a, f, AS_OF, 7).select("action_id", "message_id", "action_type")


@register(
    "pending_reviews_archived",
    O.with_tables(
        "SELECT action_id, message_id, action_type FROM pending WHERE action_type = 'archive'", *_AF, extra=[PENDING_SQL]
    ),
)
def pending_reviews_archived_q(spark, sf_dir):
    _, a, f = _tables(spark, sf_dir)
    return FB.pending_reviews(a, f, AS_OF, 7, kind="archived").select("action_id", "message_id", "action_type")


@register(
    "review_queue",
    O.with_tables(
        f"SELECT action_id, message_id, round(coalesce(abs(({SQL_JSON_SCORE}) - 0.5), 999.0), 6) AS uncertainty FROM pending",
        *_AF,
        extra=[PENDING_SQL],
    ),
)
def review_queue_q(spark, sf_dir):
    _, a, f = _tables(spark, sf_dir)
    q = FB.review_queue(FB.pending_reviews(a, f, AS_OF, 7))
    return q.select("action_id", "message_id", r6("uncertainty").alias("uncertainty"))


def _outcome_sql(since: str) -> str:
    return f"""
SELECT b.action_id, b.message_id, b.action_type, e.message_id IS NOT NULL AS state_found,
  coalesce(e.message_id IS NOT NULL AND b.action_type = 'archive' AND list_contains(e.labels, 'INBOX'), false) AS false_positive,
  coalesce(e.message_id IS NOT NULL AND list_sort(list_distinct(coalesce(b.action_labels, CAST([] AS VARCHAR[]))))
           <> list_sort(list_distinct({SQL_BOT.format(x='e.labels')})), false) AS label_change
FROM (SELECT * FROM email_actions WHERE source = 'bot' AND timestamp >= {since}) b
LEFT JOIN emails e ON e.message_id = b.message_id"""


@register("collect_feedback", O.with_tables(_outcome_sql(SINCE_7_SQL), *_A))
def collect_feedback_q(spark, sf_dir):
    e, a, _ = _tables(spark, sf_dir)
    return FB.collect_feedback(a, e, AS_OF, 7)[0]


@register(
    "collect_feedback_dedup",
    O.with_tables(
        "SELECT DISTINCT message_id FROM (" + _outcome_sql(SINCE_7_SQL) + ") WHERE false_positive AND message_id NOT IN "
        "(SELECT message_id FROM (" + _outcome_sql("TIMESTAMP '2024-01-27 00:00:00'") + ") WHERE false_positive)",
        *_A,
    ),
)
def collect_feedback_dedup_q(spark, sf_dir):
    """A run over seven days after one over four adds only what is new."""
    from ..operators import store as ST

    e, a, f = _tables(spark, sf_dir)
    first = ST.append_feedback(f, FB.collect_feedback(a, e, AS_OF, 4, dedup=True)[1])
    return FB.collect_feedback(a, e, AS_OF, 7, dedup=True, feedback=first)[1].select("message_id")


@register(
    "feedback_stats",
    O.with_tables(
        "SELECT count(*) AS bot_actions, count_if(false_positive) AS false_positives, count_if(label_change) AS label_changes, "
        "CAST(0 AS BIGINT) AS verified_correct FROM (" + _outcome_sql(SINCE_7_SQL) + ")",
        *_A,
    ),
)
def feedback_stats_q(spark, sf_dir):
    e, a, _ = _tables(spark, sf_dir)
    return FB.feedback_stats(a, e, AS_OF, 7)


@register(
    "label_changes",
    O.with_tables(
        "SELECT action_id, label_change FROM (" + _outcome_sql("TIMESTAMP '2000-01-01 00:00:00'") + ")", *_A
    ),
)
def label_changes_q(spark, sf_dir):
    e, a, _ = _tables(spark, sf_dir)
    return FB.collect_feedback(a, e, AS_OF, 365 * 24)[0].select("action_id", "label_change")


@register(
    "current_state_join",
    O.with_tables(
        "SELECT a.action_id, e.message_id IS NOT NULL AS state_found, e.labels AS state_labels "
        "FROM email_actions a LEFT JOIN emails e ON e.message_id = a.message_id WHERE a.source = 'bot'",
        *_A,
    ),
)
def current_state_join_q(spark, sf_dir):
    e, a, _ = _tables(spark, sf_dir)
    j = FB.current_state_join(a.filter(F.col("source") == "bot"), e)
    return j.select("action_id", "state_found", "state_labels")


_CORR_SQL = f"""
corr AS (
  SELECT f.*, e.from_address, e.labels,
    EXISTS (SELECT 1 FROM email_actions a WHERE a.message_id = f.message_id AND a.source = 'correction'
            AND a.timestamp >= f.review_date) AS pre,
    (f.correct_label IS NOT NULL AND f.correct_label <> '') AS has_label,
    list_transform(string_split(f.correct_label, ','), lambda y: trim(y)) AS correct
  FROM feedback_reviews f JOIN emails e ON e.message_id = f.message_id
  WHERE f.decision_correct IS FALSE OR f.label_correct IS FALSE
),
delta AS (
  SELECT *,
    CASE WHEN has_label THEN list_filter({SQL_BOT.format(x='labels')}, lambda x: NOT list_contains(correct, x))
         ELSE CAST([] AS VARCHAR[]) END AS remove,
    CASE WHEN has_label THEN list_filter(correct, lambda x: NOT list_contains({SQL_BOT.format(x='labels')}, x))
         ELSE CAST([] AS VARCHAR[]) END AS add,
    coalesce(correct_decision = 'keep', false) AS mv
  FROM corr
),
delta2 AS (SELECT *, has_label AND (len(remove) > 0 OR len(add) > 0) AS fix FROM delta),
blocks AS (SELECT message_id, min(review_id) AS b FROM delta2 WHERE (mv OR fix) AND NOT pre GROUP BY message_id),
plan AS (
  SELECT d.review_id, d.message_id, d.from_address, d.pre OR coalesce(d.review_id > k.b, false) AS already_applied,
         d.mv, d.fix, d.remove, d.add, CASE WHEN d.has_label THEN d.correct[1] END AS primary_label
  FROM delta2 d LEFT JOIN blocks k ON k.message_id = d.message_id
)"""


@register(
    "apply_corrections",
    O.with_tables(
        "SELECT review_id, message_id, from_address, already_applied, mv AND NOT already_applied AS moved_to_inbox, "
        "fix AND NOT already_applied AS labels_fixed, remove, add, primary_label FROM plan",
        *_AF,
        extra=[_CORR_SQL],
    ),
)
def apply_corrections_q(spark, sf_dir):
    e, a, f = _tables(spark, sf_dir)
    return FB.apply_corrections(f, e, a, AS_OF)["plan"]


@register(
    "correction_stats",
    O.with_tables(
        "SELECT count(*) AS total_corrections, count_if(mv AND NOT already_applied) AS moved_to_inbox, "
        "count_if(fix AND NOT already_applied) AS labels_fixed, count_if(already_applied) AS already_applied FROM plan",
        *_AF,
        extra=[_CORR_SQL],
    ),
)
def correction_stats_q(spark, sf_dir):
    e, a, f = _tables(spark, sf_dir)
    return FB.apply_corrections(f, e, a, AS_OF)["stats"]


@register(
    "learned_mappings",
    O.with_tables(
        "SELECT from_address AS sender_address, max_by(primary_label, review_id) AS label FROM plan "
        "WHERE fix AND NOT already_applied GROUP BY from_address",
        *_AF,
        extra=[_CORR_SQL],
    ),
)
def learned_mappings_q(spark, sf_dir):
    e, a, f = _tables(spark, sf_dir)
    return FB.apply_corrections(f, e, a, AS_OF)["mappings"]


@register(
    "correction_actions",
    O.with_tables(
        f"""SELECT review_id, message_id, 'move_to_inbox' AS action_type, 'correction' AS source, {AS_OF_SQL} AS timestamp
FROM plan WHERE mv AND NOT already_applied
UNION ALL
SELECT review_id, message_id, 'label_correction', 'correction', {AS_OF_SQL} FROM plan WHERE fix AND NOT already_applied""",
        *_AF,
        extra=[_CORR_SQL],
    ),
)
def correction_actions_q(spark, sf_dir):
    e, a, f = _tables(spark, sf_dir)
    acts = FB.apply_corrections(f, e, a, AS_OF)["actions"]
    return acts.select("review_id", "message_id", "action_type", "source", "timestamp")


@register(
    "label_delta",
    O.with_tables("SELECT review_id, remove, add FROM delta2", *_AF, extra=[_CORR_SQL]),
)
def label_delta_q(spark, sf_dir):
    e, a, f = _tables(spark, sf_dir)
    return FB.apply_corrections(f, e, a, AS_OF)["plan"].select("review_id", "remove", "add")


@register(
    "applied_corrections",
    O.with_tables(
        "SELECT review_id, message_id FROM feedback_reviews f WHERE EXISTS (SELECT 1 FROM email_actions a "
        "WHERE a.message_id = f.message_id AND a.source = 'correction' AND a.timestamp >= f.review_date)",
        *_AF,
    ),
)
def applied_corrections_q(spark, sf_dir):
    _, a, f = _tables(spark, sf_dir)
    return FB.applied_corrections(f, a).select("review_id", "message_id")


@register(
    "review_summary",
    O.with_tables(
        """SELECT count(*) AS reviewed,
  count_if(NOT coalesce(decision_correct IS FALSE OR label_correct IS FALSE, false)
           AND (coalesce(decision_correct, false) OR coalesce(label_correct, false))) AS correct,
  count_if(decision_correct IS FALSE OR label_correct IS FALSE) AS corrected,
  round(100.0 * count_if(NOT coalesce(decision_correct IS FALSE OR label_correct IS FALSE, false)
           AND (coalesce(decision_correct, false) OR coalesce(label_correct, false))) / count(*), 6) AS correct_pct,
  round(100.0 * count_if(decision_correct IS FALSE OR label_correct IS FALSE) / count(*), 6) AS corrected_pct
FROM feedback_reviews""",
        *_AF,
    ),
)
def review_summary_q(spark, sf_dir):
    _, _, f = _tables(spark, sf_dir)
    s = FB.review_summary(f)
    return s.select("reviewed", "correct", "corrected", r6("correct_pct").alias("correct_pct"), r6("corrected_pct").alias("corrected_pct"))


@register(
    "undo_feedback",
    O.with_tables(
        "SELECT review_id, message_id FROM feedback_reviews WHERE message_id NOT IN "
        "(SELECT message_id FROM feedback_reviews WHERE user_comment IS NOT NULL)",
        *_AF,
    ),
)
def undo_feedback_q(spark, sf_dir):
    """Undo the feedback of every mail that received a comment."""
    _, _, f = _tables(spark, sf_dir)
    undo = f.filter(F.col("user_comment").isNotNull()).select("message_id")
    return FB.undo_feedback(f, undo).select("review_id", "message_id")
