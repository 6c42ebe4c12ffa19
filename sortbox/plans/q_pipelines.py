"""Registered queries: the feature build and triage jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

from .. import oracles as O
from ..sources import bridge as B
from ..sources import messages as MS
from . import build_features as BF
from . import history_totals as HT
from . import triage as TR
from .catalog import ORACLES, SQL_DOC_SCORE, doc_score, r6, register
from .q_features import _HIST_RAW_SQL, _META_SQL, FEATURE_CUTOFF, built_features
from .q_store import NORMALIZED_CTE

NOW = dt.datetime(2024, 2, 1)
NOW_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bridged_encoder(spark, sf_dir):
    """Stand-in encoder: looks the bridged embeddings up by message id."""
    emb = B.feature_embeddings(spark, sf_dir)

    def embed(df: DataFrame) -> DataFrame:
        return df.select("message_id").join(emb, "message_id", "left")

    return embed


@register(
    "build_features",
    O.with_tables(
        f"""SELECT e.message_id, h.sender_email_count, round(h.sender_open_rate, 6) AS sender_open_rate,
  round(h.domain_open_rate, 6) AS domain_open_rate, round(h.sender_days_since_last, 6) AS sender_days_since_last,
  m.is_newsletter, CASE WHEN e.date < TIMESTAMP '{FEATURE_CUTOFF}' THEN e.date + INTERVAL 2 HOUR ELSE {NOW_SQL} END AS computed_at,
  CAST(len(fe.subject_embedding) AS INTEGER) AS subject_dims
FROM emails e JOIN ({_META_SQL}) m ON m.message_id = e.message_id JOIN ({_HIST_RAW_SQL}) h ON h.message_id = e.message_id
LEFT JOIN feature_embeddings fe ON fe.message_id = e.message_id""",
        "emails",
        "feature_embeddings",
    ),
)
def build_features_q(spark, sf_dir):
    em = B.emails(spark, sf_dir)
    out = BF.build_features(em, built_features(spark, sf_dir), NOW, embed=bridged_encoder(spark, sf_dir))["table"]
    return _round(
        out.select(
            "message_id", "sender_email_count", "sender_open_rate", "domain_open_rate", "sender_days_since_last",
            "is_newsletter", "computed_at", F.size("subject_embedding").alias("subject_dims"),
        )
    ).withColumn("subject_dims", F.when(F.col("subject_dims") >= 0, F.col("subject_dims")))


_TRIAGE_CTE = """
inc AS (SELECT n.*, row_number() OVER (ORDER BY n.date DESC, n.message_id) AS p FROM normalized n
        WHERE n.date >= TIMESTAMP '2024-01-22 00:00:00'),
com AS (SELECT * FROM emails WHERE date < TIMESTAMP '2024-01-25 00:00:00'),
com_p AS (SELECT c.*, i.p AS retriage_p FROM com c LEFT JOIN inc i ON i.message_id = c.message_id),
inc_d AS (SELECT *, CASE WHEN contains(from_address, '@') THEN lower(string_split(from_address, '@')[-1]) ELSE 'unknown' END AS dom,
                 message_id IN (SELECT message_id FROM com) AS existed FROM inc),
hist AS (
  SELECT i.message_id, i.date,
    (SELECT count(*) FROM com_p c WHERE c.from_address = i.from_address AND (c.retriage_p IS NULL OR c.retriage_p > i.p))
    + (SELECT count(*) FROM inc j WHERE j.from_address = i.from_address AND j.p < i.p)
    + CASE WHEN i.existed THEN 1 ELSE 0 END AS n,
    (SELECT coalesce(count_if(c.was_read), 0) FROM com_p c WHERE c.from_address = i.from_address AND (c.retriage_p IS NULL OR c.retriage_p > i.p))
    + (SELECT coalesce(count_if(j.was_read), 0) FROM inc j WHERE j.from_address = i.from_address AND j.p < i.p)
    + CASE WHEN i.existed AND i.was_read THEN 1 ELSE 0 END AS r,
    (SELECT count(*) FROM com_p c WHERE c.from_address ILIKE '%@' || i.dom AND (c.retriage_p IS NULL OR c.retriage_p > i.p))
    + (SELECT count(*) FROM inc j WHERE j.from_address ILIKE '%@' || i.dom AND j.p < i.p)
    + CASE WHEN i.existed AND i.from_address ILIKE '%@' || i.dom THEN 1 ELSE 0 END AS dn,
    (SELECT coalesce(count_if(c.was_read), 0) FROM com_p c WHERE c.from_address ILIKE '%@' || i.dom AND (c.retriage_p IS NULL OR c.retriage_p > i.p))
    + (SELECT coalesce(count_if(j.was_read), 0) FROM inc j WHERE j.from_address ILIKE '%@' || i.dom AND j.p < i.p)
    + CASE WHEN i.existed AND i.was_read AND i.from_address ILIKE '%@' || i.dom THEN 1 ELSE 0 END AS dr,
    (SELECT max(c.date) FROM com c WHERE c.from_address = i.from_address AND c.date < i.date) AS prev
  FROM inc_d i
)"""


def _triage_run(spark, sf_dir, scorer=None, semantic=None, since: dt.date = dt.date(2024, 1, 22), totals=None) -> dict[str, DataFrame]:
    em = B.emails(spark, sf_dir)
    committed = em.filter(F.col("date") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    raw = MS.select_messages(MS.raw_messages(spark, sf_dir), after=since)
    incoming, failed = MS.normalize_messages(raw, ntz_lit(NOW))
    # Every ninth message is delivered again; it is still one mail.
    again = F.substring("message_id", 2, 1 << 30).cast("bigint") % 9 == 0
    store = built_features(spark, sf_dir)
    return TR.triage(
        committed, incoming.unionByName(incoming.filter(again)), store, B.sender_label_mappings(spark),
        scorer=scorer or (lambda df: doc_score(F.col("message_id"))), as_of=NOW,
        embeddings=B.feature_embeddings(spark, sf_dir), semantic=semantic, failed=failed, totals=totals,
    )


@register(
    "triage",
    O.with_tables(
        f"""SELECT h.message_id, CAST(h.n AS BIGINT) AS sender_email_count,
  round(CASE WHEN h.n > 0 THEN h.r / h.n ELSE 0.0 END, 6) AS sender_open_rate,
  round(CASE WHEN h.dn > 0 THEN h.dr / h.dn ELSE 0.0 END, 6) AS domain_open_rate,
  round((epoch_us(h.date) - epoch_us(h.prev)) / 86400e6, 6) AS sender_days_since_last,
  round(s, 6) AS score,
  CASE WHEN s >= 0.7 THEN 'keep' WHEN s <= 0.3 THEN 'archive' ELSE 'keep' END AS action,
  CASE WHEN s >= 0.7 OR s <= 0.3 THEN 'high' ELSE 'low' END AS confidence
FROM (SELECT *, {SQL_DOC_SCORE.format(m='message_id')} AS s FROM hist) h""",
        "emails",
        extra=[NORMALIZED_CTE, _TRIAGE_CTE],
    ),
)
def triage_q(spark, sf_dir):
    return _triaged(_triage_run(spark, sf_dir))


def _triaged(r: dict[str, DataFrame]) -> DataFrame:
    d = r["decisions"].join(r["features"].select("message_id", "sender_email_count", "sender_open_rate", "domain_open_rate", "sender_days_since_last"), "message_id")
    return _round(
        d.select(
            "message_id", "sender_email_count", "sender_open_rate", "domain_open_rate", "sender_days_since_last",
            "score", "action", "confidence",
        )
    )


@register("triage_with_totals", ORACLES["triage"])
def triage_with_totals_q(spark, sf_dir):
    """The triage with its history from running totals: those of the mail up to January 20, and the deltas
    of the mail after it."""
    committed = B.emails(spark, sf_dir).filter(F.col("date") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    early = F.col("date") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    added = HT.deltas(committed.limit(0), committed.filter(~early))
    totals = HT.fold(HT.totals(committed.filter(early)).unionByName(added))
    return _triaged(_triage_run(spark, sf_dir, totals=totals))


_LINEAR = "0.9 * sender_open_rate + 0.3 * domain_open_rate - 0.02 * least(sender_email_count, 10)"


@register(
    "triage_by_features",
    O.with_tables(
        f"""SELECT message_id, round(s, 6) AS score,
  CASE WHEN s >= 0.7 THEN 'keep' WHEN s <= 0.3 THEN 'archive' ELSE 'keep' END AS action,
  CASE WHEN s >= 0.7 OR s <= 0.3 THEN 'high' ELSE 'low' END AS confidence
FROM (SELECT message_id, {_LINEAR} AS s FROM (
  SELECT message_id, n AS sender_email_count, CASE WHEN n > 0 THEN r / n ELSE 0.0 END AS sender_open_rate,
         CASE WHEN dn > 0 THEN dr / dn ELSE 0.0 END AS domain_open_rate FROM hist))""",
        "emails",
        extra=[NORMALIZED_CTE, _TRIAGE_CTE],
    ),
)
def triage_by_features_q(spark, sf_dir):
    """A scorer that is a table of scores, linear in the mail's features."""
    linear = lambda df: df.select("message_id", F.expr(_LINEAR).alias("score"))
    return _round(_triage_run(spark, sf_dir, linear)["decisions"].select("message_id", "score", "action", "confidence"))


@register("triage_by_model")
def triage_by_model_q(spark, sf_dir):
    """The fitted importance model scores, the fitted classifier labels."""
    from ..operators import ml as ML
    from . import q_ml

    model = q_ml._trained(spark, sf_dir)[0]
    dims = ML.embedding_width(q_ml._matrix(spark, sf_dir))
    classifier = q_ml._semantic(spark, sf_dir)[0]
    semantic = lambda df: ML.predict_semantic(classifier, df.filter(F.col("subject_embedding").isNotNull()))
    return _triage_run(spark, sf_dir, ML.model_scorer(model, dims), semantic)["decisions"].select("message_id", "score", "action", "confidence", "category")


@register(
    "triage_errors",
    O.with_tables(
        """SELECT count(*) FILTER (WHERE doc_id % 991 = 0 AND date < TIMESTAMP '2024-01-21 00:00:00') AS errors, count(*) AS total
FROM emails WHERE date >= TIMESTAMP '2024-01-02 00:00:00'""",
        "emails",
    ),
)
def triage_errors_q(spark, sf_dir):
    """Messages without an id are counted as errors of the run."""
    return _triage_run(spark, sf_dir, since=dt.date(2024, 1, 2))["summary"].select("errors", "total")


@register(
    "triage_run_summary",
    O.with_tables(
        f"""SELECT count(*) AS total, count_if(s >= 0.7) AS high_keep, count_if(s <= 0.3) AS high_archive,
  count_if(s > 0.3 AND s < 0.7) AS low_confidence, CAST(0 AS BIGINT) AS errors
FROM (SELECT {SQL_DOC_SCORE.format(m='message_id')} AS s FROM normalized WHERE date >= TIMESTAMP '2024-01-22 00:00:00')""",
        "emails",
        extra=[NORMALIZED_CTE],
    ),
)
def triage_run_summary_q(spark, sf_dir):
    return _triage_run(spark, sf_dir)["summary"]
