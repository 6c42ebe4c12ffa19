"""Registered queries: streaming jobs run to completion (AvailableNow).

The bridged mail / action tables are first staged as ordered parquet files
under the session's checkpoint folder; the stream replays them a few files
per micro-batch.  Where the streamed result must equal the batch result,
the batch oracle is reused.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

from .. import oracles as O
from ..operators import history as H
from ..operators import store as ST
from ..session import scratch_path
from ..sources import bridge as B
from ..sources import messages as MS
from ..streaming import jobs as SJ
from .catalog import doc_score, register
from .q_features import built_features
from .q_store import _OPS_SQL

TRIGGERS = 4  # micro-batches of a replay


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def stage_files(df: DataFrame, path: str, order_col: str, files: int | None = None) -> str:
    """Write ``df`` as ``files`` consecutive ``order_col`` ranges in one
    range-partitioned job, then stamp the files' modification times in range
    order, so that the file source (which replays files in modification-time
    order) sees the data in order.  By default there are as many files as
    shuffle tasks.  Scaffolding of the stream keys, not part of the jobs."""
    files = files or max(2 * TRIGGERS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(files, order_col).sortWithinPartitions(order_col).write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # part-00000 holds the lowest range; only file metadata is touched here
    parts = sorted(
        (st.getPath() for st in fs.listStatus(hpath) if st.getPath().getName().startswith("part-")),
        key=lambda p: p.getName(),
    )
    base = int(fs.getFileStatus(hpath).getModificationTime())
    for i, p in enumerate(parts):
        fs.setTimes(p, base + 1000 * (i + 1), -1)
    return path


def replay(spark, df: DataFrame, path: str, order_col: str) -> DataFrame:
    """A stream that replays ``df`` in ``order_col`` order in TRIGGERS batches or so."""
    stage_files(df, path, order_col)
    files = max(2 * TRIGGERS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return SJ.file_stream(spark, path, df.schema, -(-files // TRIGGERS))


def _mail_stream(spark, sf_dir, base: str) -> DataFrame:
    """The mail as it arrives: every seventh message days after its date."""
    em = B.emails(spark, sf_dir).select("message_id", "from_address", "date", "was_read")
    late = F.substring("message_id", 2, 1 << 30).cast("bigint") % 7 == 0
    arrived = F.when(late, F.expr("timestampadd(DAY, 5, date)")).otherwise(F.col("date"))
    return replay(spark, em.withColumn("arrived", arrived), f"{base}/mail", "arrived")


@register(
    "stream_sender_stats",
    O.with_tables(
        "SELECT from_address, count(*) AS total_emails, count_if(was_read) AS read_count FROM emails GROUP BY 1", "emails"
    ),
)
def stream_sender_stats_q(spark, sf_dir):
    base = _scratch(spark, "stream-sender-stats")
    SJ.run_updates(SJ.stream_sender_stats(_mail_stream(spark, sf_dir, base)), f"{base}/out", f"{base}/ckpt")
    return SJ.latest_rows(spark, f"{base}/out", "from_address")


@register(
    "daily_volume",
    O.with_tables("SELECT date_trunc('day', date) AS day, count(*) AS n FROM emails GROUP BY 1", "emails"),
)
def daily_volume_q(spark, sf_dir):
    """Every seventh message arrives five days late and still counts."""
    base = _scratch(spark, "stream-daily-volume")
    SJ.run_updates(SJ.daily_volume(_mail_stream(spark, sf_dir, base)), f"{base}/out", f"{base}/ckpt")
    return SJ.latest_rows(spark, f"{base}/out", "day")


@register("stream_dedup_messages", O.with_tables("SELECT message_id FROM emails", "emails"))
def stream_dedup_q(spark, sf_dir):
    """Mail re-delivered (every fourth message, three days later) is kept once."""
    base = _scratch(spark, "stream-dedup")
    em = B.emails(spark, sf_dir).select("message_id", "from_address", "date", "was_read")
    again = em.filter(F.substring("message_id", 2, 1 << 30).cast("bigint") % 4 == 0)
    sent = em.withColumn("arrived", F.col("date")).unionByName(again.withColumn("arrived", F.expr("timestampadd(DAY, 3, date)")))
    stream = replay(spark, sent, f"{base}/mail", "arrived")
    return SJ.dedup_messages(spark, stream, f"{base}/out", f"{base}/ckpt").select("message_id")


@register(
    "stream_feedback",
    O.with_tables(
        """SELECT count(*) AS bot_actions,
  count_if(b.action_type = 'archive' AND list_contains(e.labels, 'INBOX')) AS false_positives
FROM email_actions b JOIN emails e ON e.message_id = b.message_id
WHERE b.source = 'bot' AND b.timestamp >= TIMESTAMP '2024-01-24 00:00:00'""",
        "emails",
        "email_actions",
    ),
)
def stream_feedback_q(spark, sf_dir):
    """Per-epoch feedback stats summed over the replayed action log."""
    base = _scratch(spark, "stream-feedback")
    acts = B.email_actions(spark, sf_dir).drop("action_json")
    stream = replay(spark, acts, f"{base}/actions", "timestamp")
    stats = SJ.stream_feedback(
        spark, stream, B.emails(spark, sf_dir), dt.datetime(2024, 1, 31), 7, f"{base}/out", f"{base}/ckpt"
    )
    return stats.agg(F.sum("bot_actions").alias("bot_actions"), F.sum("false_positives").alias("false_positives"))


@register(
    "stream_mailbox_state",
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
def stream_mailbox_state_q(spark, sf_dir):
    """The action log as label operations, every fifth of them arriving after
    all others; the states equal the batch fold (``apply_label_ops``)."""
    base = _scratch(spark, "stream-mailbox")
    em, a = B.emails(spark, sf_dir), B.email_actions(spark, sf_dir)
    seq = lambda t, i: F.struct(t.cast("bigint").alias("at"), i.cast("bigint").alias("id")).alias("seq")
    init = em.select(
        "message_id", seq(F.lit(-1), F.lit(-1)), F.lit("init").alias("op"), F.col("labels"), F.lit(-1).cast("bigint").alias("arrived")
    )
    op = (
        F.when(F.col("action_type") == "archive", F.lit("archive"))
        .when(F.col("action_type") == "keep", F.lit("mark_read"))
        .when(F.col("action_type") == "label_add", F.lit("add_labels"))
        .otherwise(F.lit("move_to_inbox"))
    )
    at = H.epoch_us(F.col("timestamp"))
    ops = a.select(
        "message_id",
        seq(at, F.col("action_id")),
        op.alias("op"),
        F.when(F.col("action_type") == "label_add", F.array(F.lit("Bot/Receipts"))).otherwise(F.array().cast("array<string>")).alias("labels"),
        F.when(F.col("action_id") % 5 == 0, at + F.lit(10**15)).otherwise(at).cast("bigint").alias("arrived"),
    )
    stream = replay(spark, init.unionByName(ops), f"{base}/ops", "arrived")
    SJ.run_updates(SJ.label_states(stream), f"{base}/out", f"{base}/ckpt")
    states = SJ.latest_rows(spark, f"{base}/out", ["message_id", "label"])
    known = em.select("message_id")
    return ST.labels_of_states(states).join(known, "message_id", "left_semi")


@register("stream_triage")
def stream_triage_q(spark, sf_dir):
    """Incoming mail (last ten days) triaged micro-batch by micro-batch."""
    base = _scratch(spark, "stream-triage")
    now = dt.datetime(2024, 2, 1)
    em = B.emails(spark, sf_dir)
    committed = em.filter(F.col("date") < F.lit("2024-01-22 00:00:00").cast("timestamp_ntz"))
    raw = MS.select_messages(MS.raw_messages(spark, sf_dir), after=dt.date(2024, 1, 22))
    incoming, _ = MS.normalize_messages(raw, ntz_lit(now))
    stage_files(incoming, f"{base}/incoming", "date", 4)
    stream = SJ.file_stream(spark, f"{base}/incoming", incoming.schema, 2)
    dec = SJ.stream_triage(
        spark, stream, committed, built_features(spark, sf_dir), B.sender_label_mappings(spark), lambda df: doc_score(F.col("message_id")), now,
        f"{base}/out", f"{base}/ckpt", embeddings=B.feature_embeddings(spark, sf_dir),
    )
    return dec.select("message_id", "action", "confidence", "category", "labels", "epoch")
