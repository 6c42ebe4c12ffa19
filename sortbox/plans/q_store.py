"""Registered queries: raw-message normalisation, ingest jobs and table
maintenance operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

from .. import oracles as O
from ..functions import columns as C
from ..functions import mime as M
from ..operators import feedback as FB
from ..operators import features as FE
from ..operators import store as ST
from ..sources import bridge as B
from ..sources import messages as MS
from . import ingest as IG
from .catalog import r6, register
from .q_features import FEATURES_CTE, stored_features, BUILT_CTE, built_features
from .q_feedback import _CORR_SQL

NOW = dt.datetime(2024, 2, 1)
NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"

NORMALIZED_CTE = """
normalized AS (
  SELECT message_id, thread_id, from_address, coalesce(from_name, '') AS from_name, to_address,
    CASE WHEN subject IS NULL THEN CASE WHEN doc_id % 5 = 0 THEN 'Old subject' ELSE '(No Subject)' END ELSE subject END
      AS subject,
    date, coalesce(snippet, '') AS snippet, coalesce(body_plain, '') AS body_plain,
    '<p>' || coalesce(snippet, '') || '</p>' AS body_html,
    labels, was_read, was_archived, is_important, is_starred, doc_id
  FROM emails WHERE NOT (doc_id % 991 = 0 AND date < TIMESTAMP '2024-01-21 00:00:00')
)"""


def _raw(spark, sf_dir) -> DataFrame:
    return MS.raw_messages(spark, sf_dir)


def _normalized(spark, sf_dir) -> DataFrame:
    return MS.normalize_messages(_raw(spark, sf_dir), ntz_lit(NOW))[0]


def _raw_parsed(spark, sf_dir) -> DataFrame:
    parsed = _raw(spark, sf_dir).select("raw_id", F.from_json(F.col("json"), M.message_schema()).alias("m"))
    h = F.coalesce(F.col("m.payload.headers"), F.array().cast(M.HEADER_TYPE))
    return M.with_mime_parts(parsed, F.col("m.payload")).select("raw_id", h.alias("headers"), "parts")


@register(
    "normalize_messages",
    O.with_tables(
        "SELECT message_id, thread_id, from_address, from_name, to_address, subject, date, snippet, md5(body_plain) AS plain_md5, "
        "md5(body_html) AS html_md5, labels, was_read, was_archived, is_important, is_starred FROM normalized",
        "emails",
        extra=[NORMALIZED_CTE],
    ),
)
def normalize_messages_q(spark, sf_dir):
    n = _normalized(spark, sf_dir)
    return n.select(
        "message_id", "thread_id", "from_address", "from_name", "to_address", "subject", "date", "snippet",
        F.md5("body_plain").alias("plain_md5"), F.md5("body_html").alias("html_md5"), "labels", "was_read",
        "was_archived", "is_important", "is_starred",
    )


@register(
    "normalize_quarantine",
    O.with_tables("SELECT doc_id AS raw_id FROM emails WHERE doc_id % 991 = 0 AND date < TIMESTAMP '2024-01-21 00:00:00'", "emails"),
)
def normalize_quarantine_q(spark, sf_dir):
    _, bad = MS.normalize_messages(_raw(spark, sf_dir), ntz_lit(NOW))
    return bad.select("raw_id")


@register(
    "header_lookup",
    O.with_tables(
        "SELECT doc_id AS raw_id, CASE WHEN subject IS NULL THEN CASE WHEN doc_id % 5 = 0 THEN 'Old subject' END "
        "ELSE subject END AS subject_header FROM emails",
        "emails",
    ),
)
def header_lookup_q(spark, sf_dir):
    p = _raw_parsed(spark, sf_dir)
    return p.select("raw_id", M.header_lookup(F.col("headers"), "subject").alias("subject_header"))


@register(
    "parse_address",
    O.with_tables("SELECT doc_id AS raw_id, coalesce(from_name, '') AS from_name, from_address FROM emails", "emails"),
)
def parse_address_q(spark, sf_dir):
    p = _raw_parsed(spark, sf_dir).select("raw_id", M.header_lookup(F.col("headers"), "from").alias("h"))
    fast = p.select("raw_id", "h", M.address_fast_path(F.col("h")).alias("a"))
    ok = fast.filter("a.ok").select("raw_id", F.col("a.name").alias("from_name"), F.col("a.address").alias("from_address"))
    slow = fast.filter(~F.col("a.ok")).select("raw_id", M.parse_address_slow(F.col("h")).alias("s")).select(
        "raw_id", F.col("s.name").alias("from_name"), F.col("s.address").alias("from_address")
    )
    return ok.unionByName(slow)


@register("parse_mail_date", O.with_tables("SELECT doc_id AS raw_id, date FROM emails", "emails"))
def parse_mail_date_q(spark, sf_dir):
    p = _raw_parsed(spark, sf_dir)
    return p.select("raw_id", M.parse_mail_date(M.header_lookup(F.col("headers"), "date"), ntz_lit(NOW)).alias("date"))


@register(
    "extract_bodies",
    O.with_tables(
        "SELECT doc_id AS raw_id, md5(coalesce(body_plain, '')) AS plain_md5, md5('<p>' || coalesce(snippet, '') || '</p>') "
        "AS html_md5 FROM emails",
        "emails",
    ),
)
def extract_bodies_q(spark, sf_dir):
    p = _raw_parsed(spark, sf_dir)
    return p.select(
        "raw_id",
        F.md5(M.first_body(F.col("parts"), "text/plain")).alias("plain_md5"),
        F.md5(M.first_body(F.col("parts"), "text/html")).alias("html_md5"),
    )


@register(
    "label_flags",
    O.with_tables("SELECT message_id, was_read, was_archived, is_important, is_starred FROM normalized", "emails", extra=[NORMALIZED_CTE]),
)
def label_flags_q(spark, sf_dir):
    return _normalized(spark, sf_dir).select("message_id", "was_read", "was_archived", "is_important", "is_starred")


@register(
    "select_messages",
    O.with_tables(
        "SELECT doc_id AS raw_id FROM emails WHERE list_contains(labels, 'INBOX') AND date >= TIMESTAMP '2024-01-10 00:00:00' "
        "AND date < TIMESTAMP '2024-01-20 00:00:00' ORDER BY date DESC, doc_id LIMIT 100",
        "emails",
    ),
)
def select_messages_q(spark, sf_dir):
    s = MS.select_messages(_raw(spark, sf_dir), ["INBOX"], dt.date(2024, 1, 10), dt.date(2024, 1, 20), 100)
    return s.select("raw_id")


_UPSERT_SQL = f"""
SELECT e.message_id, e.from_name, e.subject, e.collected_at, CAST(NULL AS VARCHAR) AS html_md5
FROM emails e WHERE e.date < TIMESTAMP '2024-01-21 00:00:00'
  AND e.message_id NOT IN (SELECT message_id FROM normalized WHERE date >= TIMESTAMP '2024-01-15 00:00:00')
UNION ALL
SELECT n.message_id, n.from_name, n.subject, coalesce(x.collected_at, {NOW_SQL}), md5(n.body_html)
FROM normalized n LEFT JOIN (SELECT * FROM emails WHERE date < TIMESTAMP '2024-01-21 00:00:00') x ON x.message_id = n.message_id
WHERE n.date >= TIMESTAMP '2024-01-15 00:00:00'"""


@register("upsert_emails", O.with_tables(_UPSERT_SQL, "emails", extra=[NORMALIZED_CTE]))
def upsert_emails_q(spark, sf_dir):
    existing = B.emails(spark, sf_dir).filter(F.col("date") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    incoming = _normalized(spark, sf_dir).filter(F.col("date") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    t = ST.upsert_emails(existing, incoming, NOW)
    return t.select("message_id", "from_name", "subject", "collected_at", F.md5("body_html").alias("html_md5"))


def _summary_sql(start: str) -> str:
    return f"""
SELECT count(*) AS selected, count(*) - count_if(doc_id % 991 = 0 AND date < TIMESTAMP '2024-01-21 00:00:00') AS saved,
  count_if(doc_id % 991 = 0 AND date < TIMESTAMP '2024-01-21 00:00:00') AS failed,
  round(CASE WHEN count(*) > 0 THEN (count(*) - count_if(doc_id % 991 = 0 AND date < TIMESTAMP '2024-01-21 00:00:00'))
        * 100.0 / count(*) ELSE 0.0 END, 6) AS success_rate
FROM emails WHERE date >= TIMESTAMP '{start}'"""


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("ingest_history", O.with_tables(_summary_sql("2024-01-02 00:00:00"), "emails"))
def ingest_history_q(spark, sf_dir):
    existing = B.emails(spark, sf_dir).filter(F.col("date") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    return _round(IG.ingest_history(_raw(spark, sf_dir), existing, NOW, months=1)["summary"])


@register("ingest_recent", O.with_tables(_summary_sql("2024-01-25 00:00:00"), "emails"))
def ingest_recent_q(spark, sf_dir):
    existing = B.emails(spark, sf_dir).filter(F.col("date") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    return _round(IG.ingest_recent(_raw(spark, sf_dir), existing, NOW, days=7)["summary"])


@register(
    "refresh_messages",
    O.with_tables(
        "SELECT count(*) AS updated FROM normalized WHERE message_id IN (SELECT message_id FROM email_actions "
        "WHERE source = 'correction')",
        "emails",
        "email_actions",
        extra=[NORMALIZED_CTE],
    ),
)
def refresh_messages_q(spark, sf_dir):
    ids = B.email_actions(spark, sf_dir).filter(F.col("source") == "correction").select("message_id")
    return IG.refresh_messages(_raw(spark, sf_dir), B.emails(spark, sf_dir), ids, NOW)["updated"]


@register(
    "refresh_messages_table",
    O.with_tables(
        f"""SELECT e.message_id, CASE WHEN n.message_id IS NULL THEN e.from_name ELSE n.from_name END AS from_name,
       CASE WHEN n.message_id IS NULL THEN e.body_html ELSE n.body_html END IS NOT NULL AS has_html
FROM emails e LEFT JOIN (SELECT * FROM normalized WHERE message_id IN (SELECT message_id FROM email_actions
  WHERE source = 'correction')) n ON n.message_id = e.message_id""",
        "emails",
        "email_actions",
        extra=[NORMALIZED_CTE],
    ),
)
def refresh_messages_table_q(spark, sf_dir):
    ids = B.email_actions(spark, sf_dir).filter(F.col("source") == "correction").select("message_id")
    t = IG.refresh_messages(_raw(spark, sf_dir), B.emails(spark, sf_dir), ids, NOW)["table"]
    return t.select("message_id", "from_name", F.col("body_html").isNotNull().alias("has_html"))


_AS_OF = dt.datetime(2024, 1, 31)


@register(
    "append_action",
    O.with_tables(
        """SELECT action_id, message_id, action_type, source, timestamp, score, confidence, action_labels AS labels,
  CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR[]) AS removed, CAST(NULL AS VARCHAR[]) AS added, action_json
FROM email_actions
UNION ALL
SELECT NULL, message_id, 'move_to_inbox', 'correction', TIMESTAMP '2024-01-31 00:00:00', NULL, NULL, NULL, 'feedback_correction', NULL, NULL,
  '{"reason":"feedback_correction"}' FROM plan WHERE mv AND NOT already_applied
UNION ALL
SELECT NULL, message_id, 'label_correction', 'correction', TIMESTAMP '2024-01-31 00:00:00', NULL, NULL, NULL, 'feedback_correction', remove, add,
  '{"reason":"feedback_correction","removed":[' || array_to_string(list_transform(remove, lambda x: '"' || x || '"'), ',')
  || '],"added":[' || array_to_string(list_transform(add, lambda x: '"' || x || '"'), ',') || ']}'
FROM plan WHERE fix AND NOT already_applied""",
        "emails",
        "email_actions",
        "feedback_reviews",
        extra=[_CORR_SQL],
    ),
)
def append_action_q(spark, sf_dir):
    e, a, f = B.emails(spark, sf_dir), B.email_actions(spark, sf_dir), B.feedback_reviews(spark, sf_dir)
    new = FB.apply_corrections(f, e, a, _AS_OF)["actions"]
    log = ST.append_action(a, new)
    # Ids of appended rows are hashes of the row (SQL cannot compute them).
    known = F.when(F.col("action_id") < (1 << 62), F.col("action_id"))
    return log.select(known.alias("action_id"), "message_id", "action_type", "source", "timestamp", "action_data.*", "action_json")


@register(
    "append_feedback",
    O.with_tables(
        """SELECT review_id, message_id, review_date, decision_correct, label_correct, correct_decision, correct_label, user_comment,
  used_in_training FROM feedback_reviews
UNION ALL SELECT NULL, b.message_id, TIMESTAMP '2024-01-31 00:00:00', false, NULL, 'keep', NULL, '__COMMENT__', false
FROM email_actions b JOIN emails e ON e.message_id = b.message_id
WHERE b.source = 'bot' AND b.timestamp >= TIMESTAMP '2024-01-24 00:00:00' AND b.action_type = 'archive'
  AND list_contains(e.labels, 'INBOX')""".replace("__COMMENT__", FB.FALSE_POSITIVE_COMMENT),
        "emails",
        "email_actions",
        "feedback_reviews",
    ),
)
def append_feedback_q(spark, sf_dir):
    e, a, f = B.emails(spark, sf_dir), B.email_actions(spark, sf_dir), B.feedback_reviews(spark, sf_dir)
    new = FB.collect_feedback(a, e, _AS_OF, 7)[1]
    out = ST.append_feedback(f, new)
    return out.withColumn("review_id", F.when(F.col("review_id") < (1 << 62), F.col("review_id")))


@register(
    "upsert_sender_mapping",
    O.with_tables(
        """SELECT sender_address, sender_domain, label, source FROM sender_label_mappings
WHERE sender_address IS NULL OR sender_address NOT IN (SELECT from_address FROM plan WHERE fix AND NOT already_applied)
UNION ALL
SELECT from_address, NULL, max_by(primary_label, review_id), 'feedback' FROM plan WHERE fix AND NOT already_applied
GROUP BY from_address""",
        "emails",
        "email_actions",
        "feedback_reviews",
        "sender_label_mappings",
        extra=[_CORR_SQL],
    ),
)
def upsert_sender_mapping_q(spark, sf_dir):
    e, a, f = B.emails(spark, sf_dir), B.email_actions(spark, sf_dir), B.feedback_reviews(spark, sf_dir)
    learned = FB.apply_corrections(f, e, a, _AS_OF)["mappings"]
    upd = learned.select("sender_address", F.lit(None).cast("string").alias("sender_domain"), "label", F.lit(1).alias("seq"))
    out = ST.upsert_sender_mapping(B.sender_label_mappings(spark), upd)
    return out.select("sender_address", "sender_domain", "label", "source")


_META_NAMES = ["sender_domain", "is_newsletter", "day_of_week", "hour_of_day", "subject_length", "body_length"]


@register(
    "upsert_features",
    O.with_tables(
        f"""SELECT coalesce(f.message_id, u.message_id) AS message_id,
  CASE WHEN u.message_id IS NOT NULL THEN u.subject_length ELSE f.subject_length END AS subject_length,
  f.sender_email_count AS sender_email_count,
  CASE WHEN u.message_id IS NOT NULL THEN {NOW_SQL} ELSE f.computed_at END AS computed_at
FROM email_features f FULL JOIN (SELECT message_id, CAST(coalesce(length(subject), 0) AS BIGINT) AS subject_length
  FROM emails WHERE date >= TIMESTAMP '2024-01-15 00:00:00') u ON u.message_id = f.message_id""",
        "emails",
        "feature_embeddings",
        extra=[BUILT_CTE],
    ),
)
def upsert_features_q(spark, sf_dir):
    em = B.emails(spark, sf_dir)
    feats = built_features(spark, sf_dir)
    upd = FE.metadata_features(em.filter(F.col("date") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")))
    out = ST.upsert_features(feats, upd, _META_NAMES, feats.columns, NOW)
    return out.select("message_id", "subject_length", "sender_email_count", "computed_at")


@register(
    "delete_features",
    O.with_tables(
        "SELECT e.message_id, e.message_id IN (SELECT message_id FROM email_features) AS found FROM emails e WHERE e.was_archived",
        "emails",
        "feature_embeddings",
        extra=[BUILT_CTE],
    ),
)
def delete_features_q(spark, sf_dir):
    ids = B.emails(spark, sf_dir).filter("was_archived").select("message_id")
    _, found = ST.delete_features(built_features(spark, sf_dir), ids)
    return found


@register(
    "delete_features_remaining",
    O.with_tables(
        "SELECT count(*) AS remaining FROM email_features WHERE message_id NOT IN (SELECT message_id FROM emails WHERE was_archived)",
        "emails",
        "feature_embeddings",
        extra=[BUILT_CTE],
    ),
)
def delete_features_remaining_q(spark, sf_dir):
    ids = B.emails(spark, sf_dir).filter("was_archived").select("message_id")
    rest, _ = ST.delete_features(built_features(spark, sf_dir), ids)
    return rest.agg(F.count(F.lit(1)).alias("remaining"))


@register(
    "append_semantic_labels",
    O.with_tables(
        """SELECT semantic_id, message_id, label, source, model, CAST(confidence AS DOUBLE) AS confidence FROM semantic_labels
UNION ALL
SELECT NULL, message_id, array_to_string(list_transform(string_split(replace(
           regexp_replace(trim(CASE WHEN contains(from_address, '@') THEN lower(string_split(from_address, '@')[-1]) ELSE 'unknown' END),
           '^["'']+|["'']+$', '', 'g'), '_', '-'), '-'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '-'), 'llm', 'stand-in', NULL
  FROM emails WHERE message_id IN (SELECT message_id FROM email_features)
    AND message_id NOT IN (SELECT message_id FROM semantic_labels)""",
        "emails",
        "feature_embeddings",
        "semantic_labels",
        extra=[FEATURES_CTE],
    ),
)
def append_semantic_labels_q(spark, sf_dir):
    """Candidates labelled by a stand-in labeller (the sender domain,
    normalised like an external labeller's answer) and appended."""
    from ..operators import joins as J

    em = B.emails(spark, sf_dir)
    sem = B.semantic_labels(spark, sf_dir)
    cand = J.label_candidates(em, stored_features(spark, sf_dir), sem)
    new = cand.select("message_id", C.normalize_semantic_label(C.sender_domain("from_address")).alias("label"))
    out = ST.append_semantic_labels(sem, new, model="stand-in")
    return out.withColumn("semantic_id", F.when(F.col("semantic_id") < (1 << 62), F.col("semantic_id")))


@register(
    "check_references",
    O.with_tables(
        """SELECT 'email_labels' AS "table", (SELECT count(*) FROM (SELECT message_id, unnest(labels) FROM emails) x
  WHERE x.message_id NOT IN (SELECT message_id FROM live)) AS orphans
UNION ALL SELECT 'email_actions', (SELECT count(*) FROM email_actions WHERE message_id NOT IN (SELECT message_id FROM live))
UNION ALL SELECT 'feedback_reviews', (SELECT count(*) FROM feedback_reviews WHERE message_id NOT IN (SELECT message_id FROM live))
UNION ALL SELECT 'semantic_labels', (SELECT count(*) FROM semantic_labels WHERE message_id NOT IN (SELECT message_id FROM live))
UNION ALL SELECT 'email_features', (SELECT count(*) FROM email_features WHERE message_id NOT IN (SELECT message_id FROM live))""",
        "emails", "email_actions", "feedback_reviews", "semantic_labels", "feature_embeddings",
        extra=[FEATURES_CTE, "\nlive AS (SELECT message_id FROM emails WHERE NOT was_archived)"],
    ),
)
def check_references_q(spark, sf_dir):
    """Orphans left if archived mail were deleted from the mail table."""
    em = B.emails(spark, sf_dir)
    children = {
        "email_labels": ST.email_labels(em),
        "email_actions": B.email_actions(spark, sf_dir),
        "feedback_reviews": B.feedback_reviews(spark, sf_dir),
        "semantic_labels": B.semantic_labels(spark, sf_dir),
        "email_features": stored_features(spark, sf_dir),
    }
    return ST.check_references(em.filter(~F.col("was_archived")), children)


_SYS = "[" + ", ".join(f"'{x}'" for x in C.SYSTEM_LABELS) + "]"


@register(
    "label_dictionary",
    O.with_tables(
        f"""SELECT unnest({_SYS}) AS name, CAST(unnest(range(1, {len(C.SYSTEM_LABELS) + 1})) AS BIGINT) AS label_id
UNION ALL
SELECT name, CAST({len(C.SYSTEM_LABELS)} + row_number() OVER (ORDER BY name) AS BIGINT) FROM (
  SELECT DISTINCT unnest(labels) AS name FROM emails) WHERE NOT list_contains({_SYS}, name)""",
        "emails",
    ),
)
def label_dictionary_q(spark, sf_dir):
    existing = spark.createDataFrame([(n, i + 1) for i, n in enumerate(C.SYSTEM_LABELS)], "name string, label_id bigint")
    return ST.label_dictionary(existing, B.emails(spark, sf_dir))


_OPS_SQL = """
ops AS (
  SELECT message_id, action_id, timestamp,
    CASE action_type WHEN 'archive' THEN 'remove' WHEN 'keep' THEN 'remove' ELSE 'add' END AS kind,
    CASE action_type WHEN 'archive' THEN 'INBOX' WHEN 'keep' THEN 'UNREAD' WHEN 'label_add' THEN 'Bot/Receipts'
         ELSE 'INBOX' END AS label
  FROM email_actions
),
last AS (
  SELECT message_id, label, kind FROM (
    SELECT *, row_number() OVER (PARTITION BY message_id, label ORDER BY timestamp DESC, action_id DESC) AS rn FROM ops)
  WHERE rn = 1
),
final AS (
  SELECT message_id, label FROM (SELECT DISTINCT message_id, unnest(labels) AS label FROM emails) c
  WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.message_id = c.message_id AND l.label = c.label AND l.kind = 'remove')
  UNION
  SELECT message_id, label FROM last WHERE kind = 'add' AND message_id IN (SELECT message_id FROM emails)
)"""


@register(
    "apply_label_ops",
    O.with_tables(
        """SELECT e.message_id, coalesce(list_sort(f.labels), CAST([] AS VARCHAR[])) AS labels,
  NOT list_contains(coalesce(f.labels, CAST([] AS VARCHAR[])), 'UNREAD') AS was_read,
  NOT list_contains(coalesce(f.labels, CAST([] AS VARCHAR[])), 'INBOX') AS was_archived
FROM emails e LEFT JOIN (SELECT message_id, list(label) AS labels FROM final GROUP BY message_id) f ON f.message_id = e.message_id""",
        "emails",
        "email_actions",
        extra=[_OPS_SQL],
    ),
)
def apply_label_ops_q(spark, sf_dir):
    """The action log replayed as mailbox label operations: archive,
    keep (= mark read), label_add (= add Bot/Receipts), move_to_inbox."""
    a = B.email_actions(spark, sf_dir)
    op = (
        F.when(F.col("action_type") == "archive", F.lit("archive"))
        .when(F.col("action_type") == "keep", F.lit("mark_read"))
        .when(F.col("action_type") == "label_add", F.lit("add_labels"))
        .otherwise(F.lit("move_to_inbox"))
    )
    ops = a.select(
        "message_id",
        F.struct("timestamp", "action_id").alias("seq"),
        op.alias("op"),
        F.when(F.col("action_type") == "label_add", F.array(F.lit("Bot/Receipts"))).alias("labels"),
    )
    return ST.apply_label_ops(B.emails(spark, sf_dir), ops)
