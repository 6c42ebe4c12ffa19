"""Registered queries: features, decisions and the flagship summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

from .. import oracles as O
from ..functions import columns as C
from ..operators import decisions as D
from ..operators import features as FE
from ..sources import bridge as B
from ..sources.materialize import materialized
from .catalog import SQL_DOC_SCORE, SQL_SENDER_DOMAIN, doc_score, r6, register

# ---------------------------------------------------------------------------
# Flagship: features -> fixed scorer -> decision -> summary
# ---------------------------------------------------------------------------


def scored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = B.emails(spark, sf_dir)
    feats = FE.email_features(em)
    scored = feats.select("message_id", doc_score(F.col("message_id")).alias("score"))
    return D.decide(scored)


@register(
    "triage_summary",
    O.with_tables(
        f"""
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(s >= 0.7) AS BIGINT) AS high_keep,
       CAST(count_if(s <= 0.3) AS BIGINT) AS high_archive,
       CAST(count_if(s > 0.3 AND s < 0.7) AS BIGINT) AS low_confidence,
       CAST(0 AS BIGINT) AS errors
FROM (SELECT {SQL_DOC_SCORE.format(m='message_id')} AS s FROM emails)""",
        "emails",
    ),
)
def triage_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.triage_summary(scored_decisions(spark, sf_dir))


@register(
    "triage_shares",
    O.with_tables(
        f"""
SELECT CAST(count(*) AS BIGINT) AS total,
       round(count_if(s >= 0.7) * 100.0 / count(*), 6) AS high_keep_pct,
       round(count_if(s <= 0.3) * 100.0 / count(*), 6) AS high_archive_pct,
       round(count_if(s > 0.3 AND s < 0.7) * 100.0 / count(*), 6) AS low_confidence_pct
FROM (SELECT {SQL_DOC_SCORE.format(m='message_id')} AS s FROM emails)""",
        "emails",
    ),
)
def triage_shares_query(spark, sf_dir):
    sh = D.triage_shares(D.triage_summary(scored_decisions(spark, sf_dir)))
    return sh.select("total", *[r6(c).alias(c) for c in sh.columns if c != "total"])


@register(
    "decide",
    O.with_tables(
        f"""
SELECT message_id, round(s, 6) AS score,
       CASE WHEN s >= 0.7 THEN 'keep' WHEN s <= 0.3 THEN 'archive' ELSE 'keep' END AS action,
       CASE WHEN s >= 0.7 OR s <= 0.3 THEN 'high' ELSE 'low' END AS confidence
FROM (SELECT message_id, {SQL_DOC_SCORE.format(m='message_id')} AS s FROM emails)""",
        "emails",
    ),
)
def decide_query(spark, sf_dir):
    d = scored_decisions(spark, sf_dir)
    return d.select("message_id", r6("score").alias("score"), "action", "confidence")


# ---------------------------------------------------------------------------
# Features
# ---------------------------------------------------------------------------

_META_SQL = f"""
SELECT message_id,
       {SQL_SENDER_DOMAIN.format(a='from_address')} AS sender_domain,
       CASE WHEN from_address IS NULL OR from_address = '' THEN '' ELSE substr(sha256(lower(from_address)), 1, 16) END
         AS sender_address_hash,
       (contains(lower(array_to_string(labels, ' ')), 'listunsubscribe')
        OR contains(lower(array_to_string(labels, ' ')), 'listid')
        OR contains(lower(array_to_string(labels, ' ')), 'mailinglist')
        OR regexp_matches(lower(concat(coalesce(subject, ''), ' ', coalesce(body_plain, ''))),
                          'unsubscribe|newsletter|mailing.?list|subscription|opt.?out')) AS is_newsletter,
       CAST(isodow(date) - 1 AS BIGINT) AS day_of_week,
       CAST(hour(date) AS BIGINT) AS hour_of_day,
       CAST(coalesce(length(subject), 0) AS BIGINT) AS subject_length,
       CAST(coalesce(length(body_plain), 0) AS BIGINT) AS body_length,
       false AS has_attachments,
       CAST(1 AS BIGINT) AS thread_length
FROM emails"""


@register("metadata_features", O.with_tables(_META_SQL, "emails"))
def metadata_features_query(spark, sf_dir):
    return FE.metadata_features(B.emails(spark, sf_dir))


@register(
    "sender_domain",
    O.with_tables(f"SELECT message_id, {SQL_SENDER_DOMAIN.format(a='from_address')} AS sender_domain FROM emails", "emails"),
)
def sender_domain_query(spark, sf_dir):
    return B.emails(spark, sf_dir).select("message_id", C.sender_domain("from_address").alias("sender_domain"))


@register(
    "sender_hash",
    O.with_tables(
        "SELECT message_id, CASE WHEN from_address IS NULL OR from_address = '' THEN '' "
        "ELSE substr(sha256(lower(from_address)), 1, 16) END AS sender_address_hash FROM emails",
        "emails",
    ),
)
def sender_hash_query(spark, sf_dir):
    return B.emails(spark, sf_dir).select("message_id", C.sender_hash("from_address").alias("sender_address_hash"))


@register(
    "time_features",
    O.with_tables(
        "SELECT message_id, CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, CAST(hour(date) AS BIGINT) AS hour_of_day FROM emails",
        "emails",
    ),
)
def time_features_query(spark, sf_dir):
    return B.emails(spark, sf_dir).select(
        "message_id", C.day_of_week("date").alias("day_of_week"), C.hour_of_day("date").alias("hour_of_day")
    )


@register(
    "length_features",
    O.with_tables(
        "SELECT message_id, CAST(coalesce(length(subject), 0) AS BIGINT) AS subject_length, "
        "CAST(coalesce(length(body_plain), 0) AS BIGINT) AS body_length FROM emails",
        "emails",
    ),
)
def length_features_query(spark, sf_dir):
    return B.emails(spark, sf_dir).select(
        "message_id", C.text_length("subject").alias("subject_length"), C.text_length("body_plain").alias("body_length")
    )


@register(
    "is_newsletter",
    O.with_tables(
        "SELECT message_id, is_newsletter FROM (" + _META_SQL + ")",
        "emails",
    ),
)
def is_newsletter_query(spark, sf_dir):
    return B.emails(spark, sf_dir).select(
        "message_id", C.is_newsletter("labels", "subject", "body_plain").alias("is_newsletter")
    )


@register(
    "structure_stub",
    O.with_tables(
        "SELECT message_id, false AS has_attachments, CAST(1 AS BIGINT) AS thread_length, "
        "CAST(count(*) OVER (PARTITION BY thread_id) AS BIGINT) AS thread_size FROM emails",
        "emails",
    ),
)
def structure_stub_query(spark, sf_dir):
    em = B.emails(spark, sf_dir)
    m = FE.metadata_features(em, count_threads=True).select("message_id", F.col("thread_length").alias("thread_size"))
    return em.select("message_id", F.lit(False).alias("has_attachments"), F.lit(1).cast("bigint").alias("thread_length")).join(
        m, "message_id"
    )


_SENDER_STATS_SQL = """
SELECT from_address,
       CAST(count(*) AS BIGINT) AS total_emails,
       CAST(count_if(was_read) AS BIGINT) AS read_count,
       round(count_if(was_read) / count(*), 6) AS open_rate,
       CAST(count_if(was_archived) AS BIGINT) AS archived_count,
       round(count_if(was_archived) / count(*), 6) AS archive_rate
FROM emails GROUP BY from_address"""


@register("sender_stats", O.with_tables(_SENDER_STATS_SQL, "emails"))
def sender_stats_query(spark, sf_dir):
    st = FE.sender_stats(B.emails(spark, sf_dir))
    return st.select(
        "from_address", "total_emails", "read_count", r6("open_rate").alias("open_rate"), "archived_count",
        r6("archive_rate").alias("archive_rate"),
    )


# Domains compared with ILIKE, exactly as the application's per-mail query.
_DOMAIN_STATS_SQL = """
SELECT d.domain,
       CAST(count(*) AS BIGINT) AS domain_total,
       round(count_if(e.was_read) / count(*), 6) AS domain_open_rate
FROM (SELECT DISTINCT lower(string_split(from_address, '@')[-1]) AS domain FROM emails
      WHERE contains(from_address, '@')) d
JOIN emails e ON e.from_address ILIKE '%@' || d.domain
GROUP BY d.domain"""


@register("domain_stats", O.with_tables(_DOMAIN_STATS_SQL, "emails"))
def domain_stats_query(spark, sf_dir):
    ds = FE.domain_stats(B.emails(spark, sf_dir))
    return ds.select("domain", "domain_total", r6("domain_open_rate").alias("domain_open_rate"))


_PREV_SQL = """
SELECT e.message_id,
       (SELECT max(p.date) FROM emails p WHERE p.from_address = e.from_address AND p.date < e.date) AS prev_date
FROM emails e"""


@register("previous_email", O.with_tables(_PREV_SQL, "emails"))
def previous_email_query(spark, sf_dir):
    return FE.previous_email(B.emails(spark, sf_dir))


@register(
    "days_since_last",
    O.with_tables(
        "SELECT message_id, round((epoch_us(date) - epoch_us(prev_date)) / 86400e6, 6) AS sender_days_since_last "
        "FROM (SELECT e.message_id, e.date, (SELECT max(p.date) FROM emails p WHERE p.from_address = e.from_address "
        "AND p.date < e.date) AS prev_date FROM emails e)",
        "emails",
    ),
)
def days_since_last_query(spark, sf_dir):
    em = B.emails(spark, sf_dir)
    prev = FE.previous_email(em)
    return em.select("message_id", "date").join(prev, "message_id").select(
        "message_id", r6(C.days_between(F.col("date"), F.col("prev_date"))).alias("sender_days_since_last")
    )


_HIST_RAW_SQL = f"""
SELECT e.message_id,
       CAST(coalesce(s.n, 0) AS BIGINT) AS sender_email_count,
       coalesce(s.r / s.n, 0.0) AS sender_open_rate,
       (epoch_us(e.date) - epoch_us((SELECT max(p.date) FROM emails p
              WHERE p.from_address = e.from_address AND p.date < e.date))) / 86400e6 AS sender_days_since_last,
       coalesce((SELECT count_if(x.was_read) / count(*) FROM emails x
              WHERE x.from_address ILIKE '%@' || {SQL_SENDER_DOMAIN.format(a='e.from_address')}), 0.0) AS domain_open_rate
FROM emails e
LEFT JOIN (SELECT from_address, count(*) AS n, count_if(was_read) AS r FROM emails GROUP BY 1) s
  ON s.from_address = e.from_address"""

_HIST_SQL = (
    "SELECT message_id, sender_email_count, round(sender_open_rate, 6) AS sender_open_rate, "
    "round(sender_days_since_last, 6) AS sender_days_since_last, round(domain_open_rate, 6) AS domain_open_rate "
    "FROM (" + _HIST_RAW_SQL + ")"
)

# The feature table over all mail, with the bridged embeddings; and the table
# as it was at the last build, which has the mail before the cutoff only
# (newer mail is the backlog that the build, store and triage keys work on).
FEATURE_CUTOFF = "2024-01-21 00:00:00"
FEATURES_CTE = f"""
email_features AS (
  SELECT m.*, h.sender_email_count, h.sender_open_rate, h.sender_days_since_last, h.domain_open_rate,
         fe.subject_embedding, fe.body_embedding, e.date + INTERVAL 2 HOUR AS computed_at
  FROM emails e
  JOIN ({_META_SQL}) m ON m.message_id = e.message_id
  JOIN ({_HIST_RAW_SQL}) h ON h.message_id = e.message_id
  LEFT JOIN feature_embeddings fe ON fe.message_id = e.message_id
)"""
BUILT_CTE = FEATURES_CTE.rstrip(")").rstrip() + f"\n  WHERE e.date < TIMESTAMP '{FEATURE_CUTOFF}'\n)"


def _build_stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = B.emails(spark, sf_dir)
    feats = FE.email_features(em, B.feature_embeddings(spark, sf_dir))
    dates = em.select("message_id", "date")
    return feats.join(dates, "message_id").select(
        *feats.columns, F.expr("timestampadd(HOUR, 2, date)").alias("computed_at")
    )


@register("historical_features", O.with_tables(_HIST_SQL, "emails"))
def historical_features_query(spark, sf_dir):
    h = FE.historical_features(B.emails(spark, sf_dir))
    return h.select(
        "message_id",
        "sender_email_count",
        r6("sender_open_rate").alias("sender_open_rate"),
        r6("sender_days_since_last").alias("sender_days_since_last"),
        r6("domain_open_rate").alias("domain_open_rate"),
    )


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table over all mail (written once per application)."""
    return materialized(spark, f"stored_features|{sf_dir}", lambda: _build_stored_features(spark, sf_dir))


def built_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table as of the last build: mail before the cutoff."""
    dates = B.emails(spark, sf_dir).filter(F.col("date") < ntz_lit(FEATURE_CUTOFF)).select("message_id")
    return stored_features(spark, sf_dir).join(dates, "message_id", "left_semi")
