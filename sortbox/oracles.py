"""Independent SQL oracles (DuckDB dialect).

Each key's SQL rebuilds the bridged mail tables from the driver views
(``documents``, ``labels``, ``events``, ``embeddings``) as CTEs and then
computes the key.  Floats are rounded to 6 places in both engines.
"""

from __future__ import annotations

from .sources.bridge import SEED_MAPPINGS, SENDER_DOMAINS, SUBJECTS


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


_DOMAINS = "[" + ", ".join(_sql_lit(d) for d in SENDER_DOMAINS) + "]"
_SUBJECT_CASE = (
    "CASE d.doc_id % 14 "
    + " ".join(f"WHEN {i} THEN {_sql_lit(s)}" for i, s in enumerate(SUBJECTS))
    + " WHEN 13 THEN substr(d.text, 1, 60) END"
)
_DATE = "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id * 7919 % 43200 AS BIGINT)))"
_READ = "(coalesce(q.quality, CAST(d.doc_id % 3 = 0 AS INTEGER)) = 1)"

EMAILS_CTE = f"""
emails AS (
  SELECT
    concat('m', d.doc_id) AS message_id,
    concat('t', d.doc_id // 4) AS thread_id,
    CASE WHEN d.doc_id % 97 = 0 THEN concat('solo', d.doc_id, '@ab.io')
         WHEN CAST(substr(d.source, 4) AS INTEGER) = 19 THEN 'mailer-daemon'
         WHEN CAST(substr(d.source, 4) AS INTEGER) = 18 THEN 'SRC18@TechSite.COM'
         ELSE concat('src', CAST(substr(d.source, 4) AS INTEGER), '@',
                     {_DOMAINS}[CAST(substr(d.source, 4) AS INTEGER) % 8 + 1]) END AS from_address,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE concat('Sender ', CAST(substr(d.source, 4) AS INTEGER)) END AS from_name,
    'me@example.com' AS to_address,
    {_SUBJECT_CASE} AS subject,
    {_DATE} AS date,
    substr(d.text, 1, 100) AS snippet,
    CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE d.text END AS body_plain,
    CAST(NULL AS VARCHAR) AS body_html,
    list_filter([
      CASE WHEN NOT (d.doc_id % 5 = 0) THEN 'INBOX' END,
      CASE WHEN NOT {_READ} THEN 'UNREAD' END,
      CASE WHEN d.doc_id % 11 = 0 THEN 'IMPORTANT' END,
      CASE WHEN d.doc_id % 13 = 0 THEN 'STARRED' END,
      CASE WHEN d.doc_id % 17 = 0 THEN 'listid' END,
      CASE WHEN d.doc_id % 19 = 0 THEN 'Bot/Newsletter-Tech' END,
      CASE WHEN d.doc_id % 23 = 0 THEN 'Work' END], lambda x: x IS NOT NULL) AS labels,
    {_READ} AS was_read,
    (d.doc_id % 5 = 0) AS was_archived,
    (d.doc_id % 11 = 0) AS is_important,
    (d.doc_id % 13 = 0) AS is_starred,
    CAST(NULL AS TIMESTAMP) AS opened_at,
    {_DATE} + INTERVAL 1 HOUR AS collected_at,
    d.doc_id AS doc_id
  FROM documents d LEFT JOIN labels q ON d.doc_id = q.doc_id
)"""

_EID = "e.event_id"
_ASCORE = f"CASE WHEN {_EID} % 37 = 0 THEN NULL ELSE CAST({_EID} * 37 % 101 AS DOUBLE) / 100 END"
ACTIONS_CTE = f"""
email_actions AS (
  SELECT
    {_EID} AS action_id,
    concat('m', {_EID} % (SELECT count(*) FROM documents)) AS message_id,
    CASE WHEN e.event_type IN ('click', 'error') THEN 'archive'
         WHEN e.event_type = 'view' THEN 'keep'
         WHEN e.event_type = 'purchase' THEN 'label_add'
         WHEN e.event_type = 'signup' THEN 'move_to_inbox' END AS action_type,
    {_ASCORE} AS score,
    CASE WHEN {_EID} % 37 = 0 THEN NULL
         WHEN ({_ASCORE}) >= 0.7 OR ({_ASCORE}) <= 0.3 THEN 'high' ELSE 'low' END AS confidence,
    CASE WHEN {_EID} % 3 = 0 THEN ['Bot/Newsletter-Tech']
         WHEN {_EID} % 3 = 1 THEN CAST([] AS VARCHAR[])
         ELSE ['Bot/Receipts', 'Bot/LowConfidence'] END AS action_labels,
    concat('{{',
      CASE WHEN {_EID} % 41 = 0 THEN '"score": "invalid", '
           WHEN {_EID} % 37 = 0 THEN ''
           ELSE concat('"score": ', printf('%.2f', {_ASCORE}), ', ') END,
      '"labels": ',
      CASE WHEN {_EID} % 3 = 0 THEN '["Bot/Newsletter-Tech"]'
           WHEN {_EID} % 3 = 1 THEN '[]'
           ELSE '["Bot/Receipts","Bot/LowConfidence"]' END,
      '}}') AS action_json,
    e.ts AS timestamp,
    CASE WHEN e.event_type = 'purchase' THEN 'user'
         WHEN e.event_type = 'signup' THEN 'correction' ELSE 'bot' END AS source
  FROM events e
)"""

FEEDBACK_CTE = f"""
feedback_reviews AS (
  SELECT
    {_EID} AS review_id,
    concat('m', {_EID} % (SELECT count(*) FROM documents)) AS message_id,
    e.ts AS review_date,
    CASE WHEN {_EID} % 7 = 0 THEN NULL ELSE {_EID} % 2 = 0 END AS decision_correct,
    CASE WHEN {_EID} % 11 = 0 THEN NULL ELSE {_EID} % 5 <> 0 END AS label_correct,
    CASE WHEN {_EID} % 4 < 2 THEN 'keep' ELSE 'archive' END AS correct_decision,
    CASE WHEN {_EID} % 6 = 0 THEN 'Bot/Receipts' WHEN {_EID} % 6 = 3 THEN 'Bot/A, Bot/B' END AS correct_label,
    CASE WHEN {_EID} % 4 = 0 THEN 'moved back' END AS user_comment,
    ({_EID} % 5 = 0) AS used_in_training
  FROM events e
  WHERE e.event_type = 'purchase' AND {_EID} % 3 = 0
)"""

MAPPINGS_CTE = (
    "\nsender_label_mappings AS (\n  SELECT * FROM (VALUES "
    + ", ".join(
        f"({i + 1}, {_sql_lit(a)}, {_sql_lit(d)}, {_sql_lit(lab)}, 'user')" for i, (a, d, lab) in enumerate(SEED_MAPPINGS)
    )
    + ") AS t(mapping_id, sender_address, sender_domain, label, source)\n)"
)

FEATURE_EMB_CTE = """
feature_embeddings AS (
  SELECT concat('m', d.doc_id) AS message_id,
         CAST(s.embedding AS DOUBLE[]) AS subject_embedding,
         CAST(b.embedding AS DOUBLE[]) AS body_embedding
  FROM documents d
  LEFT JOIN embeddings s ON s.vec_id = d.doc_id
  LEFT JOIN embeddings b ON b.vec_id = d.doc_id + 1
)"""

SEMANTIC_CTE = """
semantic_labels AS (
  SELECT x.vec_id AS semantic_id, concat('m', d.doc_id) AS message_id,
         concat('Label-', x.label) AS label, 'user' AS source, 'bridge' AS model, 1.0 AS confidence
  FROM embeddings x JOIN documents d ON x.vec_id = d.doc_id
)"""

ALL_CTES = {
    "emails": EMAILS_CTE,
    "email_actions": ACTIONS_CTE,
    "feedback_reviews": FEEDBACK_CTE,
    "sender_label_mappings": MAPPINGS_CTE,
    "feature_embeddings": FEATURE_EMB_CTE,
    "semantic_labels": SEMANTIC_CTE,
}


def with_tables(body: str, *names: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the bridge CTEs it uses (in dependency order)."""
    ctes = [ALL_CTES[n] for n in names]
    if extra:
        ctes.extend(extra)
    if not ctes:
        return body
    return "WITH " + ",".join(ctes) + "\n" + body
