"""Registered query: the labels a triage run applies, with an oracle.

The oracle recomputes the suggestion waterfall for the incoming mail with
the sequential sender counts of the run (``hist``), the embeddings of the
incoming mail against the label centroids, and the fallback keywords over
the normalised subject and snippet.
"""

from __future__ import annotations

from .. import oracles as O
from .catalog import SQL_DOC_SCORE, register
from .q_features import BUILT_CTE
from .q_labels import CENTROID_SQL, MAPPED_SQL, SQL_IS_NEWSLETTER, SQL_LEARNED_FIRST, SQL_TEXT, sql_contains_any, sql_domain_to_label
from .q_labels import LB
from .q_pipelines import _TRIAGE_CTE, _triage_run
from .q_store import NORMALIZED_CTE

_DL = sql_domain_to_label("string_split(f.from_address, '@')[2]")
_FB = f"""CASE
  WHEN {sql_contains_any(SQL_TEXT.format(e='f.'), LB.FALLBACK_RECEIPT[1])} THEN 'Bot/Receipts'
  WHEN {sql_contains_any(SQL_TEXT.format(e='f.'), LB.FALLBACK_AUTOMATED[1])} THEN 'Bot/Automated'
  WHEN {sql_contains_any(SQL_TEXT.format(e='f.'), LB.FALLBACK_PROMOTIONAL[1])} THEN 'Bot/Promotional'
  WHEN f.is_newsletter THEN 'Bot/Newsletters'
  ELSE 'Bot/Personal' END"""

TRIAGE_LABELS_CTE = f"""
inc_feat AS (
  SELECT i.message_id, i.from_address, i.subject, i.snippet, h.n AS sender_count,
         {SQL_IS_NEWSLETTER.format(e='i.')} AS is_newsletter, fe.subject_embedding,
         {SQL_DOC_SCORE.format(m='i.message_id')} AS s
  FROM inc_d i JOIN hist h ON h.message_id = i.message_id
  LEFT JOIN feature_embeddings fe ON fe.message_id = i.message_id
),
tnearest AS (
  SELECT f.message_id, arg_max(cc.label, struct_pack(s := c.sim, l := -cc.rank)) AS nearest_label
  FROM inc_feat f
  JOIN (SELECT x.*, dense_rank() OVER (ORDER BY x.label) AS rank FROM centroids x) cc ON true
  CROSS JOIN LATERAL (SELECT list_dot_product(f.subject_embedding, cc.centroid)
       / (sqrt(list_dot_product(f.subject_embedding, f.subject_embedding)) * sqrt(list_dot_product(cc.centroid, cc.centroid))) AS sim) c
  WHERE f.subject_embedding IS NOT NULL AND len(f.subject_embedding) > 0
    AND list_dot_product(f.subject_embedding, f.subject_embedding) > 0
    AND list_dot_product(cc.centroid, cc.centroid) > 0 AND c.sim > 0.75
  GROUP BY f.message_id
),
tbase AS (
  SELECT f.message_id, f.s, {SQL_LEARNED_FIRST.format(e='f.')} AS learned,
    CASE WHEN f.subject_embedding IS NOT NULL AND len(f.subject_embedding) > 0 AND n.nearest_label IS NOT NULL
         THEN n.nearest_label END AS cent,
    CASE WHEN f.sender_count >= 3 AND contains(f.from_address, '@') AND {_DL} IS NOT NULL THEN 'Bot/' || {_DL} END AS send,
    {_FB} AS fb
  FROM inc_feat f LEFT JOIN tnearest n ON n.message_id = f.message_id
),
tkept AS (
  SELECT message_id, s, learned, cent, send_k AS send,
         CASE WHEN fb IS DISTINCT FROM cent AND fb IS DISTINCT FROM send_k THEN fb END AS fb
  FROM (SELECT *, CASE WHEN cent IS NULL OR send <> cent THEN send END AS send_k FROM tbase)
),
tsugg AS (
  SELECT message_id, s,
    CASE WHEN learned IS NOT NULL THEN [learned]
    ELSE list_transform(list_sort(list_filter([
        CASE WHEN cent IS NOT NULL THEN {{'k': 2, 'i': 0, 'label': cent}} END,
        CASE WHEN send IS NOT NULL THEN {{'k': 3, 'i': 1, 'label': send}} END,
        CASE WHEN fb IS NOT NULL THEN {{'k': CASE WHEN fb = 'Bot/Personal' THEN 5 ELSE 4 END, 'i': 2, 'label': fb}} END
      ], lambda x: x IS NOT NULL)), lambda x: x.label) END AS labs
  FROM tkept
)"""


def _labels_sql() -> str:
    return O.with_tables(
        """SELECT message_id, labs[1] AS category,
  list_concat([labs[1]],
    CASE WHEN len(labs) > 1 AND labs[2] <> labs[1] THEN [labs[2]] ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN s > 0.3 AND s < 0.7 THEN ['Bot/LowConfidence'] ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN s <= 0.3 THEN ['Bot/AutoArchived'] ELSE CAST([] AS VARCHAR[]) END) AS labels
FROM tsugg""",
        "emails",
        "feature_embeddings",
        "sender_label_mappings",
        extra=[NORMALIZED_CTE, _TRIAGE_CTE, BUILT_CTE, MAPPED_SQL, CENTROID_SQL, TRIAGE_LABELS_CTE],
    )


@register("triage_labels", _labels_sql())
def triage_labels_q(spark, sf_dir):
    """Labels the triage run applies: primary, the second if different,
    LowConfidence when uncertain, AutoArchived when archiving."""
    return _triage_run(spark, sf_dir)["decisions"].select("message_id", "category", "labels")
