"""Registered queries: label operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import oracles as O
from ..functions import columns as C
from ..operators import features as FE
from ..operators import labels as LB
from ..sources import bridge as B
from .catalog import r6, register
from .q_features import FEATURES_CTE, stored_features


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_contains_any(text: str, kws: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(k)})" for k in kws) + ")"


SQL_IS_NEWSLETTER = (
    "(contains(lower(array_to_string({e}labels, ' ')), 'listunsubscribe') "
    "OR contains(lower(array_to_string({e}labels, ' ')), 'listid') "
    "OR contains(lower(array_to_string({e}labels, ' ')), 'mailinglist') "
    "OR regexp_matches(lower(concat(coalesce({e}subject, ''), ' ', coalesce({e}body_plain, ''))), "
    "'unsubscribe|newsletter|mailing.?list|subscription|opt.?out'))"
)
SQL_TEXT = "lower(concat(coalesce({e}subject, ''), ' ', coalesce({e}snippet, '')))"

SQL_LEARNED_LAST = """(SELECT coalesce(
   (SELECT min_by(m.label, m.mapping_id) FROM sender_label_mappings m WHERE m.sender_address = {e}from_address),
   (SELECT min_by(m.label, m.mapping_id) FROM sender_label_mappings m WHERE m.sender_address IS NULL
      AND contains({e}from_address, '@') AND m.sender_domain = string_split({e}from_address, '@')[-1])))"""
SQL_LEARNED_FIRST = """(SELECT coalesce(
   (SELECT min_by(m.label, m.mapping_id) FROM sender_label_mappings m WHERE m.sender_address = {e}from_address),
   (SELECT min_by(m.label, m.mapping_id) FROM sender_label_mappings m WHERE m.sender_address IS NULL
      AND contains({e}from_address, '@') AND m.sender_domain = string_split({e}from_address, '@')[2])))"""


def sql_rule_category(e: str = "") -> str:
    t = SQL_TEXT.format(e=e)
    work = (
        "(" + sql_contains_any(f"lower({e}from_address)", LB.WORK_ADDRESS_MARKERS)
        + " OR " + sql_contains_any(f"lower(coalesce({e}subject, ''))", LB.WORK_SUBJECT_KEYWORDS) + ")"
    )
    return f"""CASE
  WHEN {sql_contains_any(t, LB.RECEIPT_INDICATORS)} THEN '{LB.RECEIPTS}'
  WHEN {sql_contains_any(t, LB.AUTOMATED_INDICATORS)} THEN '{LB.AUTOMATED}'
  WHEN {sql_contains_any(t, LB.PROMO_INDICATORS)} THEN '{LB.PROMOTIONAL}'
  WHEN {SQL_IS_NEWSLETTER.format(e=e)} THEN CASE
     WHEN {sql_contains_any(t, LB.TECH_KEYWORDS)} THEN '{LB.NEWSLETTER_TECH}'
     WHEN {sql_contains_any(t, LB.FINANCE_KEYWORDS)} THEN '{LB.NEWSLETTER_FINANCE}'
     WHEN {sql_contains_any(t, LB.NEWS_KEYWORDS)} THEN '{LB.NEWSLETTER_NEWS}'
     ELSE '{LB.NEWSLETTER_OTHER}' END
  WHEN {work} THEN '{LB.WORK}'
  ELSE '{LB.PERSONAL}' END"""


def sql_capitalize(w: str) -> str:
    return f"(upper(substr({w}, 1, 1)) || lower(substr({w}, 2)))"


def sql_clean_label(n: str) -> str:
    kept = f"regexp_replace({n}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')"
    stripped = f"trim({kept})"
    dashed = f"regexp_replace({stripped}, '\\s+', '-', 'g')"
    joined = (
        f"array_to_string(list_transform(list_filter(string_split({dashed}, '-'), lambda w: w <> ''), "
        f"lambda w: {sql_capitalize('w')}), '-')"
    )
    return (
        f"(SELECT CASE WHEN length(j) > 30 THEN CASE WHEN contains(substr(j, 1, 30), '-') "
        f"THEN regexp_extract(substr(j, 1, 30), '^(.*)-[^-]*$', 1) ELSE substr(j, 1, 30) END ELSE j END "
        f"FROM (SELECT {joined} AS j))"
    )


def sql_domain_to_label(d: str) -> str:
    x = f"lower({d})"
    for s in C.DOMAIN_SUFFIXES + C.DOMAIN_PREFIXES:
        x = f"replace({x}, '{s}', '')"
    return f"(SELECT CASE WHEN length(p) >= 3 THEN {sql_clean_label('p')} END FROM (SELECT {x} AS p))"


def _features_for_labels(spark, sf_dir) -> DataFrame:
    return stored_features(spark, sf_dir).select("message_id", "is_newsletter", "subject_embedding")


_MAP = ("emails", "sender_label_mappings")


@register(
    "sender_label",
    O.with_tables(f"SELECT e.message_id, {SQL_LEARNED_LAST.format(e='e.')} AS learned_label FROM emails e", *_MAP),
)
def sender_label_q(spark, sf_dir):
    em = B.emails(spark, sf_dir).select("message_id", "from_address")
    return LB.with_learned_label(em, B.sender_label_mappings(spark), "last").select("message_id", "learned_label")


@register(
    "sender_label_adaptive",
    O.with_tables(f"SELECT e.message_id, {SQL_LEARNED_FIRST.format(e='e.')} AS learned_label FROM emails e", *_MAP),
)
def sender_label_adaptive_q(spark, sf_dir):
    em = B.emails(spark, sf_dir).select("message_id", "from_address")
    return LB.with_learned_label(em, B.sender_label_mappings(spark), "first").select("message_id", "learned_label")


@register(
    "categorize",
    O.with_tables(
        f"SELECT e.message_id, coalesce({SQL_LEARNED_LAST.format(e='e.')}, {sql_rule_category('e.')}) AS category FROM emails e",
        *_MAP,
    ),
)
def categorize_q(spark, sf_dir):
    em = B.emails(spark, sf_dir)
    em = em.withColumn("is_newsletter", C.is_newsletter("labels", "subject", "body_plain"))
    return LB.categorize(em, B.sender_label_mappings(spark)).select("message_id", "category")


@register(
    "is_work_email",
    O.with_tables(
        "SELECT message_id, ("
        + sql_contains_any("lower(from_address)", LB.WORK_ADDRESS_MARKERS)
        + " OR "
        + sql_contains_any("lower(coalesce(subject, ''))", LB.WORK_SUBJECT_KEYWORDS)
        + ") AS is_work FROM emails",
        "emails",
    ),
)
def is_work_email_q(spark, sf_dir):
    return B.emails(spark, sf_dir).select("message_id", LB.is_work_email().alias("is_work"))


@register(
    "contains_any",
    O.with_tables(
        "SELECT message_id, "
        + sql_contains_any(SQL_TEXT.format(e=""), LB.TECH_KEYWORDS)
        + " AS tech_hit, "
        + sql_contains_any(SQL_TEXT.format(e=""), LB.PROMO_INDICATORS)
        + " AS promo_hit FROM emails",
        "emails",
    ),
)
def contains_any_q(spark, sf_dir):
    t = LB.category_text()
    return B.emails(spark, sf_dir).select(
        "message_id", C.contains_any(t, LB.TECH_KEYWORDS).alias("tech_hit"), C.contains_any(t, LB.PROMO_INDICATORS).alias("promo_hit")
    )


_FB_SQL = f"""CASE
  WHEN {sql_contains_any(SQL_TEXT.format(e=''), LB.FALLBACK_RECEIPT[1])} THEN {{'label': 'Bot/Receipts', 'specificity': 4, 'confidence': 0.5}}
  WHEN {sql_contains_any(SQL_TEXT.format(e=''), LB.FALLBACK_AUTOMATED[1])} THEN {{'label': 'Bot/Automated', 'specificity': 4, 'confidence': 0.5}}
  WHEN {sql_contains_any(SQL_TEXT.format(e=''), LB.FALLBACK_PROMOTIONAL[1])} THEN {{'label': 'Bot/Promotional', 'specificity': 4, 'confidence': 0.5}}
  WHEN {SQL_IS_NEWSLETTER.format(e='')} THEN {{'label': 'Bot/Newsletters', 'specificity': 4, 'confidence': 0.6}}
  ELSE {{'label': 'Bot/Personal', 'specificity': 5, 'confidence': 0.3}} END"""


@register(
    "fallback_category",
    O.with_tables(
        f"SELECT message_id, f.label AS label, CAST(f.specificity AS INTEGER) AS specificity, CAST(f.confidence AS DOUBLE) AS confidence "
        f"FROM (SELECT message_id, {_FB_SQL} AS f FROM emails)",
        "emails",
    ),
)
def fallback_category_q(spark, sf_dir):
    em = B.emails(spark, sf_dir)
    s = LB.fallback_suggestion(LB.category_text(), C.is_newsletter("labels", "subject", "body_plain"))
    return em.select("message_id", s.alias("s")).select(
        "message_id", F.col("s.label").alias("label"), F.col("s.specificity").alias("specificity"), F.col("s.confidence").alias("confidence")
    )


@register(
    "clean_label_name",
    O.with_tables(f"SELECT message_id, {sql_clean_label('subject')} AS clean_label FROM emails", "emails"),
)
def clean_label_name_q(spark, sf_dir):
    return B.emails(spark, sf_dir).select("message_id", C.clean_label_name("subject").alias("clean_label"))


@register(
    "domain_to_label",
    O.with_tables(
        "SELECT message_id, " + sql_domain_to_label("string_split(from_address, '@')[2]") + " AS domain_label "
        "FROM emails WHERE contains(from_address, '@')",
        "emails",
    ),
)
def domain_to_label_q(spark, sf_dir):
    em = B.emails(spark, sf_dir).filter(F.col("from_address").contains("@"))
    return em.select("message_id", C.domain_to_label(C.raw_domain_first("from_address")).alias("domain_label"))


@register(
    "sender_specific_label",
    O.with_tables(
        f"""SELECT e.message_id,
  CASE WHEN c.n >= 3 AND contains(e.from_address, '@')
        AND {sql_domain_to_label("string_split(e.from_address, '@')[2]")} IS NOT NULL
       THEN 'Bot/' || {sql_domain_to_label("string_split(e.from_address, '@')[2]")} END AS sender_label
FROM emails e JOIN (SELECT from_address, count(*) AS n FROM emails GROUP BY 1) c ON c.from_address = e.from_address""",
        "emails",
    ),
)
def sender_specific_label_q(spark, sf_dir):
    em = B.emails(spark, sf_dir).select("message_id", "from_address")
    cnt = em.groupBy("from_address").agg(F.count(F.lit(1)).alias("n"))
    s = LB.sender_specific_suggestion(F.col("from_address"), F.col("n"))
    return em.join(cnt, "from_address").select("message_id", s["label"].alias("sender_label"))


@register(
    "normalize_semantic_label",
    O.with_tables(
        "SELECT message_id, array_to_string(list_transform(string_split(replace(regexp_replace(trim(subject), "
        "'^[\"'']+|[\"'']+$', '', 'g'), '_', '-'), '-'), lambda w: "
        + sql_capitalize("w")
        + "), '-') AS semantic_label FROM emails",
        "emails",
    ),
)
def normalize_semantic_label_q(spark, sf_dir):
    return B.emails(spark, sf_dir).select("message_id", C.normalize_semantic_label("subject").alias("semantic_label"))


@register(
    "infer_correct_decision",
    O.with_tables(
        "SELECT action_id, CASE WHEN action_type = 'archive' THEN 'keep' ELSE 'archive' END AS correct_decision "
        "FROM email_actions",
        "email_actions",
    ),
)
def infer_correct_decision_q(spark, sf_dir):
    a = B.email_actions(spark, sf_dir)
    return a.select("action_id", C.infer_correct_decision("action_type").alias("correct_decision"))


@register(
    "confidence_label",
    O.with_tables(
        f"""SELECT message_id,
  list_concat([c], CASE WHEN s > 0.3 AND s < 0.7 THEN ['Bot/LowConfidence'] ELSE CAST([] AS VARCHAR[]) END,
              CASE WHEN s <= 0.3 THEN ['Bot/AutoArchived'] ELSE CAST([] AS VARCHAR[]) END) AS labels
FROM (SELECT e.message_id, CAST(CAST(substr(e.message_id, 2) AS BIGINT) * 37 % 101 AS DOUBLE) / 100 AS s,
             coalesce({SQL_LEARNED_LAST.format(e='e.')}, {sql_rule_category('e.')}) AS c FROM emails e)""",
        *_MAP,
    ),
)
def confidence_label_q(spark, sf_dir):
    """Category label + LowConfidence (uncertain score) + AutoArchived."""
    from ..operators import decisions as D
    from .catalog import doc_score

    em = B.emails(spark, sf_dir)
    em = em.withColumn("is_newsletter", C.is_newsletter("labels", "subject", "body_plain"))
    cat = LB.categorize(em, B.sender_label_mappings(spark))
    action, conf = D.decide_columns(doc_score(F.col("message_id")))
    return cat.select("message_id", LB.action_labels(LB.confidence_labels(F.col("category"), conf), action).alias("labels"))


@register(
    "action_label",
    O.with_tables(
        f"""SELECT message_id,
  list_concat([c], CASE WHEN s <= 0.3 THEN ['Bot/AutoArchived'] ELSE CAST([] AS VARCHAR[]) END) AS labels
FROM (SELECT e.message_id, CAST(CAST(substr(e.message_id, 2) AS BIGINT) * 37 % 101 AS DOUBLE) / 100 AS s,
             coalesce({SQL_LEARNED_LAST.format(e='e.')}, {sql_rule_category('e.')}) AS c FROM emails e)""",
        *_MAP,
    ),
)
def action_label_q(spark, sf_dir):
    """Category label + AutoArchived when the decision is archive."""
    from ..operators import decisions as D
    from .catalog import doc_score

    em = B.emails(spark, sf_dir)
    em = em.withColumn("is_newsletter", C.is_newsletter("labels", "subject", "body_plain"))
    cat = LB.categorize(em, B.sender_label_mappings(spark))
    action, _ = D.decide_columns(doc_score(F.col("message_id")))
    return cat.select("message_id", LB.action_labels(F.array(F.col("category")), action).alias("labels"))


_EMB = ("emails", "feature_embeddings", "sender_label_mappings")

SAMPLE_SQL = """
sample AS (
  SELECT * FROM (
    SELECT e.message_id, e.from_address, m.label, f.subject_embedding,
           row_number() OVER (PARTITION BY m.label, e.from_address ORDER BY e.date DESC, e.message_id) AS rank
    FROM emails e
    JOIN (SELECT DISTINCT sender_address, label FROM sender_label_mappings WHERE sender_address IS NOT NULL) m
      ON m.sender_address = e.from_address
    JOIN email_features f ON f.message_id = e.message_id)
  WHERE rank <= 10
)"""
# Centroids are taken over all mail of a mapped sender; the sample of ten has
# its own keys.
MAPPED_SQL = SAMPLE_SQL.replace("\n  WHERE rank <= 10", "")
CENTROID_SQL = """
centroids AS (
  SELECT label, list_transform(list_sort(list(struct_pack(pos := pos, v := v))), lambda x: x.v) AS centroid, max(n) AS n
  FROM (SELECT label, pos, avg(v) AS v, count(*) AS n FROM (
          SELECT label, message_id, generate_subscripts(subject_embedding, 1) - 1 AS pos, unnest(subject_embedding) AS v
          FROM sample WHERE len(subject_embedding) > 0)
        GROUP BY label, pos)
  GROUP BY label
)"""


@register(
    "sender_sample_10",
    O.with_tables("SELECT message_id, from_address, label, CAST(rank AS INTEGER) AS rank FROM sample", *_EMB, extra=[FEATURES_CTE, SAMPLE_SQL]),
)
def sender_sample_q(spark, sf_dir):
    s = LB.sender_sample(B.emails(spark, sf_dir), stored_features(spark, sf_dir), B.sender_label_mappings(spark))
    return s.select("message_id", "from_address", "label", "rank")


@register(
    "label_centroids",
    O.with_tables(
        "SELECT label, list_transform(centroid, lambda x: round(x, 6)) AS centroid, CAST(n AS BIGINT) AS n FROM centroids",
        *_EMB,
        extra=[FEATURES_CTE, MAPPED_SQL, CENTROID_SQL],
    ),
)
def label_centroids_q(spark, sf_dir):
    c = LB.label_centroids(B.emails(spark, sf_dir), stored_features(spark, sf_dir), B.sender_label_mappings(spark))
    return c.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"), "n")


@register(
    "label_centroids_10",
    O.with_tables(
        "SELECT label, list_transform(centroid, lambda x: round(x, 6)) AS centroid, CAST(n AS BIGINT) AS n FROM centroids",
        *_EMB,
        extra=[FEATURES_CTE, SAMPLE_SQL, CENTROID_SQL],
    ),
)
def label_centroids_10_q(spark, sf_dir):
    """As the application has it: the newest ten mails of each sender."""
    c = LB.label_centroids(B.emails(spark, sf_dir), stored_features(spark, sf_dir), B.sender_label_mappings(spark), per_sender=10)
    return c.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"), "n")


_COS_SQL = """CASE WHEN {a} IS NULL OR {b} IS NULL OR len({a}) = 0 OR len({b}) = 0
   OR list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0
   ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"""


@register(
    "cosine_similarity",
    O.with_tables(
        "SELECT message_id, round(" + _COS_SQL.format(a="subject_embedding", b="body_embedding") + ", 6) AS cosine "
        "FROM feature_embeddings",
        "emails",
        "feature_embeddings",
    ),
)
def cosine_similarity_q(spark, sf_dir):
    fe = B.feature_embeddings(spark, sf_dir)
    return fe.select("message_id", r6(LB.cosine_similarity(F.col("subject_embedding"), F.col("body_embedding"))).alias("cosine"))


NEAREST_SQL = """
nearest AS (
  SELECT f.message_id,
         arg_max(c.label, struct_pack(s := c.sim, l := -rank)) AS nearest_label, max(c.sim) AS similarity
  FROM email_features f
  JOIN (SELECT x.*, dense_rank() OVER (ORDER BY x.label) AS rank FROM centroids x) cc ON true
  CROSS JOIN LATERAL (SELECT cc.label AS label,
       list_dot_product(f.subject_embedding, cc.centroid)
         / (sqrt(list_dot_product(f.subject_embedding, f.subject_embedding)) * sqrt(list_dot_product(cc.centroid, cc.centroid))) AS sim) c
  WHERE f.subject_embedding IS NOT NULL AND len(f.subject_embedding) > 0
    AND list_dot_product(f.subject_embedding, f.subject_embedding) > 0
    AND list_dot_product(cc.centroid, cc.centroid) > 0 AND c.sim > 0.75
  GROUP BY f.message_id
)"""


@register(
    "nearest_label",
    O.with_tables(
        "SELECT f.message_id, n.nearest_label, round(n.similarity, 6) AS similarity "
        "FROM email_features f LEFT JOIN nearest n ON n.message_id = f.message_id",
        *_EMB,
        extra=[FEATURES_CTE, MAPPED_SQL, CENTROID_SQL, NEAREST_SQL],
    ),
)
def nearest_label_q(spark, sf_dir):
    em = B.emails(spark, sf_dir)
    feats = stored_features(spark, sf_dir)
    cents = LB.label_centroids(em, feats, B.sender_label_mappings(spark))
    n = LB.nearest_label(feats, cents)
    return n.select("message_id", "nearest_label", r6("similarity").alias("similarity"))


@register(
    "nearest_label_lists",
    O.with_tables(
        "SELECT f.message_id, n.nearest_label, round(n.similarity, 6) AS similarity "
        "FROM email_features f LEFT JOIN nearest n ON n.message_id = f.message_id",
        *_EMB,
        extra=[
            FEATURES_CTE,
            "centroids AS (SELECT 'L-' || message_id AS label, subject_embedding AS centroid FROM email_features "
            "WHERE len(subject_embedding) > 0 AND CAST(substr(message_id, 2) AS BIGINT) % 2 = 0)",
            NEAREST_SQL,
        ],
    ),
)
def nearest_label_lists_q(spark, sf_dir):
    """As many labels as there is mail with an even number, each mail its own: inverted lists."""
    feats = stored_features(spark, sf_dir)
    even = F.substring("message_id", 2, 1 << 30).cast("bigint") % 2 == 0
    cents = feats.filter((F.size("subject_embedding") > 0) & even).select(F.concat(F.lit("L-"), "message_id").alias("label"), F.col("subject_embedding").alias("centroid"))
    n = LB.nearest_label(feats, cents, packed_labels=0)
    return n.select("message_id", "nearest_label", r6("similarity").alias("similarity"))


@register(
    "centroid_match",
    O.with_tables(
        """SELECT message_id, arg_max(label, struct_pack(c := cosine, r := -rank)) AS label, round(max(cosine), 6) AS cosine FROM (
  SELECT f.message_id, c.label, dense_rank() OVER (ORDER BY c.label) AS rank, """
        + _COS_SQL.format(a="f.subject_embedding", b="c.centroid")
        + """ AS cosine
  FROM email_features f JOIN centroids c ON list_dot_product(c.centroid, c.centroid) > 0
  WHERE len(f.subject_embedding) > 0 AND list_dot_product(f.subject_embedding, f.subject_embedding) > 0)
GROUP BY message_id""",
        *_EMB,
        extra=[FEATURES_CTE, MAPPED_SQL, CENTROID_SQL],
    ),
)
def centroid_match_q(spark, sf_dir):
    """Best label and cosine of every mail with an embedding."""
    feats = stored_features(spark, sf_dir)
    cents = LB.label_centroids(B.emails(spark, sf_dir), feats, B.sender_label_mappings(spark))
    best = LB.nearest_label(feats, cents, threshold=-2.0).filter(F.col("nearest_label").isNotNull())
    return best.select("message_id", F.col("nearest_label").alias("label"), r6("similarity").alias("cosine"))


_DL = sql_domain_to_label("string_split(e.from_address, '@')[2]")
_FBL = f"""CASE
  WHEN {sql_contains_any(SQL_TEXT.format(e='e.'), LB.FALLBACK_RECEIPT[1])} THEN 'Bot/Receipts'
  WHEN {sql_contains_any(SQL_TEXT.format(e='e.'), LB.FALLBACK_AUTOMATED[1])} THEN 'Bot/Automated'
  WHEN {sql_contains_any(SQL_TEXT.format(e='e.'), LB.FALLBACK_PROMOTIONAL[1])} THEN 'Bot/Promotional'
  WHEN coalesce(f.is_newsletter, false) THEN 'Bot/Newsletters'
  ELSE 'Bot/Personal' END"""
SUGGESTIONS_SQL = f"""
cnt AS (SELECT from_address, count(*) AS n FROM emails GROUP BY 1),
base AS (
  SELECT e.message_id, {SQL_LEARNED_FIRST.format(e='e.')} AS learned,
    CASE WHEN f.subject_embedding IS NOT NULL AND len(f.subject_embedding) > 0 AND n.nearest_label IS NOT NULL
         THEN n.nearest_label END AS cent,
    CASE WHEN c.n >= 3 AND contains(e.from_address, '@') AND {_DL} IS NOT NULL THEN 'Bot/' || {_DL} END AS send,
    {_FBL} AS fb
  FROM emails e
  LEFT JOIN email_features f ON f.message_id = e.message_id
  LEFT JOIN nearest n ON n.message_id = e.message_id
  LEFT JOIN cnt c ON c.from_address = e.from_address
),
kept AS (
  SELECT message_id, learned, cent, send_k AS send,
         CASE WHEN fb IS DISTINCT FROM cent AND fb IS DISTINCT FROM send_k THEN fb END AS fb
  FROM (SELECT *, CASE WHEN cent IS NULL OR send <> cent THEN send END AS send_k FROM base)
),
suggestions AS (
  SELECT message_id,
    CASE WHEN learned IS NOT NULL THEN [{{'k': 1, 'i': 0, 'label': learned}}]
    ELSE list_sort(list_filter([
        CASE WHEN cent IS NOT NULL THEN {{'k': 2, 'i': 0, 'label': cent}} END,
        CASE WHEN send IS NOT NULL THEN {{'k': 3, 'i': 1, 'label': send}} END,
        CASE WHEN fb IS NOT NULL THEN {{'k': CASE WHEN fb = 'Bot/Personal' THEN 5 ELSE 4 END, 'i': 2, 'label': fb}} END
      ], lambda x: x IS NOT NULL)) END AS s
  FROM kept
)"""
_GEN_TABLES = ("emails", "feature_embeddings", "sender_label_mappings")
_GEN_EXTRA = [FEATURES_CTE, MAPPED_SQL, CENTROID_SQL, NEAREST_SQL, SUGGESTIONS_SQL]


def _generated(spark, sf_dir) -> DataFrame:
    em = B.emails(spark, sf_dir)
    return LB.generate_labels(em, stored_features(spark, sf_dir), B.sender_label_mappings(spark))


@register(
    "generate_labels",
    O.with_tables(
        "SELECT message_id, list_transform(s, lambda x: x.label) AS labels, "
        "list_transform(s, lambda x: CAST(x.k AS INTEGER)) AS specificities FROM suggestions",
        *_GEN_TABLES,
        extra=_GEN_EXTRA,
    ),
)
def generate_labels_q(spark, sf_dir):
    g = _generated(spark, sf_dir)
    return g.select(
        "message_id",
        F.transform("suggestions", lambda s: s["label"]).alias("labels"),
        F.transform("suggestions", lambda s: s["specificity"]).alias("specificities"),
    )


# Deterministic stand-in of the classifier: label and confidence by id.
_SEM_SQL = """
semantic AS (
  SELECT message_id, CASE doc_id % 3 WHEN 0 THEN 'Receipts' WHEN 1 THEN 'Travel' ELSE 'Newsletter-Tech' END AS sem_label,
         CAST(doc_id % 10 AS DOUBLE) / 10 AS conf FROM emails
),
sem_base AS (
  SELECT b.*, CASE WHEN len(f.subject_embedding) > 0 AND s.conf >= 0.4 THEN 'Bot/' || s.sem_label END AS sem
  FROM base b JOIN semantic s ON s.message_id = b.message_id LEFT JOIN email_features f ON f.message_id = b.message_id
),
sem_cent AS (SELECT *, CASE WHEN sem IS NULL OR cent <> sem THEN cent END AS cent_k FROM sem_base),
sem_send AS (
  SELECT *, CASE WHEN coalesce(sem, cent_k) IS NULL OR send <> coalesce(sem, cent_k) THEN send END AS send_k FROM sem_cent
),
sem_kept AS (
  SELECT message_id, learned, sem, cent_k, send_k,
         CASE WHEN fb IS DISTINCT FROM sem AND fb IS DISTINCT FROM cent_k AND fb IS DISTINCT FROM send_k THEN fb END AS fb FROM sem_send
),
sem_suggestions AS (
  SELECT message_id, CASE WHEN learned IS NOT NULL THEN [{'k': 1, 'i': 0, 'label': learned}]
    ELSE list_sort(list_filter([
        CASE WHEN sem IS NOT NULL THEN {'k': 2, 'i': 0, 'label': sem} END,
        CASE WHEN cent_k IS NOT NULL THEN {'k': 2, 'i': 1, 'label': cent_k} END,
        CASE WHEN send_k IS NOT NULL THEN {'k': 3, 'i': 2, 'label': send_k} END,
        CASE WHEN fb IS NOT NULL THEN {'k': CASE WHEN fb = 'Bot/Personal' THEN 5 ELSE 4 END, 'i': 3, 'label': fb} END
      ], lambda x: x IS NOT NULL)) END AS s
  FROM sem_kept
)"""


@register(
    "generate_labels_semantic",
    O.with_tables(
        "SELECT message_id, list_transform(s, lambda x: x.label) AS labels FROM sem_suggestions",
        *_GEN_TABLES,
        extra=[*_GEN_EXTRA, _SEM_SQL],
    ),
)
def generate_labels_semantic_q(spark, sf_dir):
    """The waterfall with its semantic stage."""
    em = B.emails(spark, sf_dir)
    doc = F.substring("message_id", 2, 1 << 30).cast("bigint")
    label = F.when(doc % 3 == 0, "Receipts").when(doc % 3 == 1, "Travel").otherwise("Newsletter-Tech")
    sem = em.select("message_id", label.alias("sem_label"), ((doc % 10).cast("double") / 10).alias("sem_confidence"))
    g = LB.generate_labels(em, stored_features(spark, sf_dir), B.sender_label_mappings(spark), semantic=sem)
    return g.select("message_id", F.transform("suggestions", lambda s: s["label"]).alias("labels"))


@register(
    "rank_suggestions",
    O.with_tables(
        "SELECT message_id, list_transform(s, lambda x: CAST(x.k AS INTEGER)) AS specificities FROM suggestions",
        *_GEN_TABLES,
        extra=_GEN_EXTRA,
    ),
)
def rank_suggestions_q(spark, sf_dir):
    g = _generated(spark, sf_dir)
    return g.select("message_id", F.transform("suggestions", lambda s: s["specificity"]).alias("specificities"))


@register(
    "primary_label",
    O.with_tables(
        "SELECT message_id, coalesce(s[1].label, 'Bot/Uncategorized') AS primary_label, "
        "list_transform(s[1:2], lambda x: x.label) AS max_labels FROM suggestions",
        *_GEN_TABLES,
        extra=_GEN_EXTRA,
    ),
)
def primary_label_q(spark, sf_dir):
    g = _generated(spark, sf_dir)
    return g.select(
        "message_id", LB.primary_label(F.col("suggestions")).alias("primary_label"), LB.max_labels(F.col("suggestions"), 2).alias("max_labels")
    )


@register(
    "max_labels",
    O.with_tables(
        "SELECT message_id, list_transform(s[1:2], lambda x: x.label) AS max_labels FROM suggestions",
        *_GEN_TABLES,
        extra=_GEN_EXTRA,
    ),
)
def max_labels_q(spark, sf_dir):
    g = _generated(spark, sf_dir)
    return g.select("message_id", LB.max_labels(F.col("suggestions"), 2).alias("max_labels"))
