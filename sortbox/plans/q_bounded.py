"""Registered queries: streams with bounded state, bucketed upserts, vectors stored by content."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import oracles as O
from ..operators import buckets as BU
from ..operators import embedding_store as ES
from ..operators import history as H
from ..operators import store as ST
from ..session import scratch_path
from ..sources import bridge as B
from ..streaming import bounded as SB
from ..streaming import jobs as SJ
from . import q_store as QS
from . import q_stream as QT
from .catalog import SQL_DOC_SCORE, register

KEEP_MS = 30 * 86_400_000  # a mail's state expires a month after its last operation


@register(
    "stream_mailbox_state_expiring",
    O.with_tables(
        """SELECT e.message_id, coalesce(list_sort(f.labels), CAST([] AS VARCHAR[])) AS labels,
  NOT list_contains(coalesce(f.labels, CAST([] AS VARCHAR[])), 'UNREAD') AS was_read,
  NOT list_contains(coalesce(f.labels, CAST([] AS VARCHAR[])), 'INBOX') AS was_archived
FROM emails e LEFT JOIN (SELECT message_id, list(label) AS labels FROM final GROUP BY message_id) f ON f.message_id = e.message_id""",
        "emails",
        "email_actions",
        extra=[QS._OPS_SQL],
    ),
)
def stream_mailbox_state_expiring_q(spark, sf_dir):
    """The action log as label operations, every fifth of them arriving after all others, folded with
    ``transformWithState``; the states equal the batch fold."""
    base = QT._scratch(spark, "stream-mailbox-expiring")
    em, a = B.emails(spark, sf_dir), B.email_actions(spark, sf_dir)
    none = F.array().cast("array<string>")
    init = em.select(
        "message_id", F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("id")).alias("seq"),
        F.lit("init").alias("op"), "labels", F.lit(-1).cast("bigint").alias("arrived"),
    )
    names = {"archive": "archive", "keep": "mark_read", "label_add": "add_labels", "move_to_inbox": "move_to_inbox"}
    op = F.lit(None).cast("string")
    for action, name in names.items():
        op = F.when(F.col("action_type") == action, F.lit(name)).otherwise(op)
    at = H.epoch_us(F.col("timestamp")).cast("bigint")
    ops = a.select(
        "message_id", F.struct(at.alias("at"), F.col("action_id").cast("bigint").alias("id")).alias("seq"), op.alias("op"),
        F.when(F.col("action_type") == "label_add", F.array(F.lit("Bot/Receipts"))).otherwise(none).alias("labels"),
        F.when(F.col("action_id") % 5 == 0, at + F.lit(10**15)).otherwise(at).cast("bigint").alias("arrived"),
    )
    sent = init.unionByName(ops)
    QT.stage_files(sent, f"{base}/ops", "arrived")
    files = max(2 * QT.TRIGGERS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stream = SJ.file_stream(SB.stateful_session(spark), f"{base}/ops", sent.schema, -(-files // QT.TRIGGERS))
    SB.mailbox_states(stream, f"{base}/out", f"{base}/ckpt", KEEP_MS)
    states = SB.newest_states(SB.EpochLog(spark, f"{base}/out", SB.CHANGES).rows())
    return ST.labels_of_states(states).join(em.select("message_id"), "message_id", "left_semi")


@register("stream_dedup_indexed", O.with_tables("SELECT message_id, from_address, date FROM emails", "emails"))
def stream_dedup_indexed_q(spark, sf_dir):
    """Mail re-delivered (every fourth message, three days later) is kept once, by the id index."""
    base = QT._scratch(spark, "stream-dedup-indexed")
    em = B.emails(spark, sf_dir).select("message_id", "from_address", "date", "was_read")
    again = em.filter(F.substring("message_id", 2, 1 << 30).cast("bigint") % 4 == 0)
    sent = em.withColumn("arrived", F.col("date")).unionByName(again.withColumn("arrived", F.expr("timestampadd(DAY, 3, date)")))
    stream = QT.replay(spark, sent, f"{base}/mail", "arrived")
    return SB.dedup_by_bucket(stream, f"{base}/out", f"{base}/ckpt", buckets=16, compact_every=2).select("message_id", "from_address", "date")


@register(
    "daily_volume_closing",
    O.with_tables("SELECT date_trunc('day', date) AS day, count(*) AS n FROM emails GROUP BY 1", "emails"),
)
def daily_volume_closing_q(spark, sf_dir):
    """Days close two days after their end; every seventh message arrives five days late.  Closed days,
    open days and late rows together count every message."""
    base = QT._scratch(spark, "stream-daily-closing")
    days, late = SB.closing_daily_volume(QT._mail_stream(spark, sf_dir, base), f"{base}/out", f"{base}/ckpt")
    return SB.volume_with_late(days, late)


@register(
    "stream_triage_decisions",
    O.with_tables(
        f"""SELECT message_id, CASE WHEN s >= 0.7 THEN 'keep' WHEN s <= 0.3 THEN 'archive' ELSE 'keep' END AS action,
  CASE WHEN s >= 0.7 OR s <= 0.3 THEN 'high' ELSE 'low' END AS confidence
FROM (SELECT message_id, {SQL_DOC_SCORE.format(m='message_id')} AS s FROM normalized WHERE date >= TIMESTAMP '2024-01-22 00:00:00')""",
        "emails",
        extra=[QS.NORMALIZED_CTE],
    ),
)
def stream_triage_decisions_q(spark, sf_dir):
    """What the streamed triage decides: each incoming mail once, decided as the batch triage does."""
    return QT.stream_triage_q(spark, sf_dir).select("message_id", "action", "confidence")


@register("upsert_emails_bucketed", O.with_tables(QS._UPSERT_SQL, "emails", extra=[QS.NORMALIZED_CTE]))
def upsert_emails_bucketed_q(spark, sf_dir):
    """The upsert of ``upsert_emails`` on a stored table of which only touched buckets are rewritten."""
    path = scratch_path(spark, f"mail-buckets-{uuid.uuid4().hex[:12]}")
    before = F.col("date") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")
    BU.write_bucketed(B.emails(spark, sf_dir).filter(before).select(*ST.EMAIL_COLUMNS, "opened_at", "collected_at"), path, buckets=64)
    incoming = QS._normalized(spark, sf_dir).filter(F.col("date") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    BU.upsert_bucketed(path, incoming, lambda old, new: ST.upsert_emails(old, new, QS.NOW), buckets=64)
    t = BU.read_bucketed(spark, path, buckets=64)
    return t.select("message_id", "from_name", "subject", "collected_at", F.md5("body_html").alias("html_md5"))


@register(
    "embed_by_content",
    O.with_tables(
        """SELECT message_id, CASE WHEN trim(coalesce(subject, '')) <> '' THEN 64 END::INTEGER AS subject_dims,
  CASE WHEN trim(coalesce(nullif(body_plain, ''), nullif(snippet, ''), '')) <> '' THEN 64 END::INTEGER AS body_dims FROM emails""",
        "emails",
    ),
)
def embed_by_content_q(spark, sf_dir):
    """Subjects and bodies encoded once per distinct text (hashing encoder, 64 slots)."""
    from ..functions import columns as C

    mail = B.emails(spark, sf_dir).select("message_id", "subject", C.body_source("body_plain", "snippet").alias("body"))
    vectors = scratch_path(spark, f"vectors-{uuid.uuid4().hex[:12]}")
    out = ES.embed_by_content(mail, {"subject": "subject_vector", "body": "body_vector"}, "hashing-64", vectors, dims=64)
    size = lambda c: F.when(F.size(c) >= 0, F.size(c))
    return out.select("message_id", size("subject_vector").alias("subject_dims"), size("body_vector").alias("body_dims"))
