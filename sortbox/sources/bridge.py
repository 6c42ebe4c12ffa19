"""Derive the mail tables from the driver's synthetic tables.

Every mapping is integer arithmetic over ids plus literals, so that an
independent SQL engine derives bit-identical tables (see ``sortbox.oracles``).

* emails            <- documents LEFT JOIN labels
* email_actions     <- events
* feedback_reviews  <- events (purchase events, every third id)
* sender_label_mappings <- literal seed rows (a dimension table)
* email_features    <- embeddings (subject / body embeddings)
* semantic_labels   <- embeddings
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .materialize import materialized
from .tables import read_table

# Fixed values of the bridge (they must equal the SQL oracle's).
SENDER_DOMAINS = [
    "techsite.com",
    "email.shop.com",
    "bank.io",
    "news.org",
    "university.edu",
    "company.com",
    "ab.io",
    "newsletters.digest.net",
]
SUBJECTS = [
    "Your payment receipt",
    "Order confirmation #123",
    "GitHub notification",
    "Alert: server down",
    "50% off sale today!",
    "Limited time offer",
    "Weekly Newsletter: Tech Updates",
    "Meeting tomorrow",
    "Stock portfolio - click to unsubscribe",
    None,
    "World news: opt out",
    "Mailing list digest",
    "Python API subscription",
]
SEED_MAPPINGS = [
    # (sender_address, sender_domain, label)
    ("src0@techsite.com", None, "Bot/Newsletter-Tech"),
    ("src1@email.shop.com", None, "Bot/Deals"),
    ("src5@company.com", None, "Bot/Work"),
    (None, "bank.io", "Bot/Finance"),
    (None, "news.org", "Bot/News"),
]
BASE_TS = "2024-01-01 00:00:00"


def fixed_score(id_col: Column) -> Column:
    """The integer-arithmetic scorer used by the checked keys."""
    return (id_col * 37 % 101).cast("double") / 100


def _build_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    quality = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = docs.join(quality, "doc_id", "left")
    doc = F.col("doc_id")
    sn = F.expr("cast(substr(source, 4) as int)")
    domain = F.element_at(F.array(*[F.lit(x) for x in SENDER_DOMAINS]), (sn % 8 + 1).cast("int"))
    from_address = (
        F.when(doc % 97 == 0, F.concat(F.lit("solo"), doc.cast("string"), F.lit("@ab.io")))
        .when(sn == 19, F.lit("mailer-daemon"))
        .when(sn == 18, F.lit("SRC18@TechSite.COM"))
        .otherwise(F.concat(F.lit("src"), sn.cast("string"), F.lit("@"), domain))
    )
    subject = F.when((doc % 14) == 13, F.substring("text", 1, 60)).otherwise(
        F.element_at(F.array(*[F.lit(x).cast("string") for x in SUBJECTS]), (doc % 14 + 1).cast("int"))
    )
    date = F.expr(f"timestampadd(MINUTE, doc_id * 7919 % 43200, TIMESTAMP_NTZ'{BASE_TS}')")
    was_read = F.coalesce(F.col("quality"), (doc % 3 == 0).cast("int")) == 1
    was_archived = doc % 5 == 0
    labels = F.array_compact(
        F.array(
            F.when(~was_archived, F.lit("INBOX")),
            F.when(~was_read, F.lit("UNREAD")),
            F.when(doc % 11 == 0, F.lit("IMPORTANT")),
            F.when(doc % 13 == 0, F.lit("STARRED")),
            F.when(doc % 17 == 0, F.lit("listid")),
            F.when(doc % 19 == 0, F.lit("Bot/Newsletter-Tech")),
            F.when(doc % 23 == 0, F.lit("Work")),
        )
    )
    out = d.select(
        F.concat(F.lit("m"), doc.cast("string")).alias("message_id"),
        F.concat(F.lit("t"), F.floor(doc / 4).cast("bigint").cast("string")).alias("thread_id"),
        from_address.alias("from_address"),
        F.when(doc % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Sender "), sn.cast("string")))
        .alias("from_name"),
        F.lit("me@example.com").alias("to_address"),
        subject.alias("subject"),
        date.alias("date"),
        F.substring("text", 1, 100).alias("snippet"),
        F.when(doc % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("body_plain"),
        F.lit(None).cast("string").alias("body_html"),
        labels.alias("labels"),
        was_read.alias("was_read"),
        was_archived.alias("was_archived"),
        (doc % 11 == 0).alias("is_important"),
        (doc % 13 == 0).alias("is_starred"),
        F.lit(None).cast("timestamp_ntz").alias("opened_at"),
        F.expr("timestampadd(HOUR, 1, " + f"timestampadd(MINUTE, doc_id * 7919 % 43200, TIMESTAMP_NTZ'{BASE_TS}'))").alias(
            "collected_at"
        ),
    )
    return out


def email_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id with its numeric id (for keys that need the id)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return docs.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("message_id"), "doc_id")


def _action_type(et: Column) -> Column:
    return (
        F.when(et.isin("click", "error"), F.lit("archive"))
        .when(et == "view", F.lit("keep"))
        .when(et == "purchase", F.lit("label_add"))
        .when(et == "signup", F.lit("move_to_inbox"))
    )


def _action_labels(eid: Column) -> Column:
    return (
        F.when(eid % 3 == 0, F.array(F.lit("Bot/Newsletter-Tech")))
        .when(eid % 3 == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("Bot/Receipts"), F.lit("Bot/LowConfidence")))
    )


def _build_email_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action log.  ``action_data`` is typed; ``action_json`` is the raw
    JSON text as an audit log would hold it (score may be a string)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    n_docs = read_table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    eid = F.col("event_id")
    score = F.when(eid % 37 == 0, F.lit(None).cast("double")).otherwise(fixed_score(eid))
    confidence = F.when(score.isNull(), F.lit(None).cast("string")).when(
        (score >= 0.7) | (score <= 0.3), F.lit("high")
    ).otherwise(F.lit("low"))
    labels = _action_labels(eid)
    score_json = (
        F.when(eid % 41 == 0, F.lit('"score": "invalid", '))
        .when(eid % 37 == 0, F.lit(""))
        .otherwise(F.concat(F.lit('"score": '), F.format_string("%.2f", score), F.lit(", ")))
    )
    action_json = F.concat(
        F.lit("{"),
        score_json,
        F.lit('"labels": '),
        F.to_json(labels),
        F.lit("}"),
    )
    return ev.select(
        eid.alias("action_id"),
        F.concat(F.lit("m"), (eid % n_docs).cast("string")).alias("message_id"),
        _action_type(F.col("event_type")).alias("action_type"),
        F.struct(
            score.alias("score"),
            confidence.alias("confidence"),
            labels.alias("labels"),
            F.lit(None).cast("string").alias("reason"),
            F.lit(None).cast("array<string>").alias("removed"),
            F.lit(None).cast("array<string>").alias("added"),
        ).alias("action_data"),
        action_json.alias("action_json"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "purchase", F.lit("user"))
        .when(F.col("event_type") == "signup", F.lit("correction"))
        .otherwise(F.lit("bot"))
        .alias("source"),
    )


def _build_feedback_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    n_docs = read_table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    eid = F.col("event_id")
    ev = ev.filter((F.col("event_type") == "purchase") & (eid % 3 == 0))
    return ev.select(
        eid.alias("review_id"),
        F.concat(F.lit("m"), (eid % n_docs).cast("string")).alias("message_id"),
        F.col("ts").alias("review_date"),
        F.when(eid % 7 == 0, F.lit(None).cast("boolean")).otherwise(eid % 2 == 0).alias("decision_correct"),
        F.when(eid % 11 == 0, F.lit(None).cast("boolean")).otherwise(eid % 5 != 0).alias("label_correct"),
        F.when(eid % 4 < 2, F.lit("keep")).otherwise(F.lit("archive")).alias("correct_decision"),
        F.when(eid % 6 == 0, F.lit("Bot/Receipts"))
        .when(eid % 6 == 3, F.lit("Bot/A, Bot/B"))
        .otherwise(F.lit(None).cast("string"))
        .alias("correct_label"),
        F.when(eid % 4 == 0, F.lit("moved back")).otherwise(F.lit(None).cast("string")).alias("user_comment"),
        (eid % 5 == 0).alias("used_in_training"),
    )


def sender_label_mappings(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, a, d, lab, "user") for i, (a, d, lab) in enumerate(SEED_MAPPINGS)]
    return spark.createDataFrame(
        rows, "mapping_id bigint, sender_address string, sender_domain string, label string, source string"
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def _build_feature_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_embedding = embedding of vec_id = doc_id; body_embedding =
    embedding of vec_id = doc_id + 1 (both NULL when absent)."""
    emb = embeddings(spark, sf_dir).select("vec_id", "embedding")
    ids = email_doc_ids(spark, sf_dir)
    subj = emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("subject_embedding"))
    body = emb.select((F.col("vec_id") - 1).alias("doc_id"), F.col("embedding").alias("body_embedding"))
    return ids.join(subj, "doc_id", "left").join(body, "doc_id", "left").drop("doc_id")


def _build_semantic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ids = email_doc_ids(spark, sf_dir)
    return emb.join(ids, emb.vec_id == ids.doc_id, "inner").select(
        F.col("vec_id").alias("semantic_id"),
        "message_id",
        F.concat(F.lit("Label-"), F.col("label").cast("string")).alias("label"),
        F.lit("user").alias("source"),
        F.lit("bridge").alias("model"),
        F.lit(1.0).alias("confidence"),
    )


# Stored forms of the derived tables (written once per application).
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, f"emails|{sf_dir}", lambda: _build_emails(spark, sf_dir))


def email_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, f"email_actions|{sf_dir}", lambda: _build_email_actions(spark, sf_dir))


def feedback_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, f"feedback_reviews|{sf_dir}", lambda: _build_feedback_reviews(spark, sf_dir))


def feature_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, f"feature_embeddings|{sf_dir}", lambda: _build_feature_embeddings(spark, sf_dir))


def semantic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, f"semantic_labels|{sf_dir}", lambda: _build_semantic_labels(spark, sf_dir))
