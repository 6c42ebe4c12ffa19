"""Structured Streaming jobs.

The application runs as scheduled batches (triage in the morning, feedback
in the evening); here each is a streaming query over files of mail or
actions, usually with ``Trigger.AvailableNow`` so a scheduler can run it
like a batch while the checkpoint keeps exactly-once progress.

No job has a watermark: late mail and late operations count like any other.
Their state is bounded by what the tables hold anyway (a row per sender,
day, or label of a mail).

* ``stream_sender_stats``, ``daily_volume``: running aggregates, update mode.
* ``dedup_messages``: each message is stored once, checked against the ids
  stored by earlier epochs.
* ``stream_triage`` / ``stream_feedback``: ``foreachBatch`` around the
  batch jobs.
* ``label_states``: last operation on each (mail, label), update mode.

Every epoch writes its own output partition in overwrite mode, so a replayed
epoch replaces its output (idempotent); ``latest_rows`` reads the current
rows of such a table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import feedback as FB
from ..operators import store as ST
from ..plans import history_totals as HT
from ..plans import triage as TR
from ..sources.tables import path_exists
from .log import EpochLog

COMPACT_EVERY = 10  # epochs of history totals folded into one


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def with_event_time(stream: DataFrame, ts: str = "date") -> DataFrame:
    """Watermarks need a TIMESTAMP column; mail dates are naive wall clock,
    read here as UTC (through epoch microseconds, independent of the
    session time zone)."""
    from ..operators.history import epoch_us

    return stream.withColumn("event_time", F.timestamp_micros(epoch_us(F.col(ts))))


def _to_ntz(ts_col: F.Column) -> F.Column:
    """TIMESTAMP -> naive wall clock in UTC (inverse of ``with_event_time``)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts_col), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def stream_sender_stats(mail: DataFrame) -> DataFrame:
    return mail.groupBy("from_address").agg(
        F.count(F.lit(1)).alias("total_emails"), F.count_if(F.col("was_read")).alias("read_count")
    )


def daily_volume(mail: DataFrame) -> DataFrame:
    """Messages per day; a late message updates its day."""
    m = with_event_time(mail)
    return m.groupBy(F.window("event_time", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(
        _to_ntz(F.col("window.start")).alias("day"), "n"
    )


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """Write an epoch's rows; writing the epoch again replaces them."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def earlier_rows(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """Rows of the epochs before ``epoch`` (None when nothing is written).
    A table that is there and cannot be read fails the job."""
    return spark.read.parquet(path).filter(F.col("epoch") < epoch) if path_exists(spark, path) else None


def latest_rows(spark: SparkSession, path: str, key: str | list[str]) -> DataFrame:
    """The last epoch's row of each key."""
    return ST.latest_per_key(spark.read.parquet(path), key, ["epoch"]).drop("epoch")


def dedup_messages(spark: SparkSession, mail: DataFrame, out_dir: str, checkpoint: str) -> DataFrame:
    """Store each message once, however late it is delivered again."""

    def handle(batch: DataFrame, epoch: int) -> None:
        new = ST.latest_mail(batch)
        stored = earlier_rows(spark, out_dir, epoch)
        if stored is not None:
            new = new.join(stored.select("message_id"), "message_id", "left_anti")
        write_epoch(new, out_dir, epoch)

    run_available(mail, checkpoint, handle, "append")
    return spark.read.parquet(out_dir).drop("epoch")


def run_updates(sdf: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Run a stream in update mode; each epoch's changed rows are written."""
    run_available(sdf, checkpoint, lambda batch, epoch: write_epoch(batch, out_dir, epoch), "update")


def run_available(sdf: DataFrame, checkpoint: str, foreach_batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a streaming query over everything available, then stop."""
    w = sdf.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(foreach_batch).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_triage(
    spark: SparkSession,
    incoming: DataFrame,
    committed: DataFrame,
    feature_store: DataFrame,
    mappings: DataFrame,
    scorer,
    as_of: dt.datetime,
    out_dir: str,
    checkpoint: str,
    embeddings: DataFrame | None = None,
) -> DataFrame:
    """Triage each micro-batch of incoming mail.

    Sender, domain and last-date totals are aggregated once, from ``committed``,
    and kept up by each epoch's deltas.  A batch sees the committed mail and features together with what earlier
    epochs wrote (the last epoch's row of each message).  Each epoch writes
    its mail, features, actions and decisions.  Returns the decisions."""
    dirs = {n: f"{out_dir}/{n}" for n in ("mail", "features", "actions", "decisions")}

    def current(base: DataFrame, name: str, epoch: int) -> DataFrame:
        logged = earlier_rows(spark, dirs[name], epoch)
        if logged is None:
            return base
        rows = base.withColumn("epoch", F.lit(-1)).unionByName(logged.select(*base.columns, "epoch"))
        return ST.latest_per_key(rows, "message_id", ["epoch"]).drop("epoch")

    log = EpochLog(spark, f"{out_dir}/history", HT.SCHEMA)

    def handle(batch: DataFrame, epoch: int) -> None:
        store, mail = current(feature_store, "features", epoch), current(committed, "mail", epoch)
        if log.rows(epoch) is None:
            log.start(HT.totals(committed))
        totals = HT.fold(log.rows(epoch))
        r = TR.triage(mail, batch, store, mappings, scorer, as_of, embeddings=embeddings, totals=totals)
        new = ST.latest_mail(batch)
        log.write(HT.deltas(mail.join(new.select("message_id"), "message_id", "left_semi"), new), epoch)
        if epoch % COMPACT_EVERY == COMPACT_EVERY - 1:
            log.compact(epoch, HT.fold)
        ids = r["decisions"].select("message_id")
        write_epoch(r["decisions"], dirs["decisions"], epoch)
        write_epoch(r["actions"], dirs["actions"], epoch)
        write_epoch(r["emails"].select(*committed.columns).join(ids, "message_id", "left_semi"), dirs["mail"], epoch)
        write_epoch(r["feature_table"].select(*feature_store.columns).join(ids, "message_id", "left_semi"), dirs["features"], epoch)

    run_available(incoming, checkpoint, handle)
    return spark.read.parquet(dirs["decisions"])


def stream_feedback(
    spark: SparkSession, actions: DataFrame, mailbox: DataFrame, as_of: dt.datetime, days: int, out_dir: str, checkpoint: str
) -> DataFrame:
    """Collect feedback per micro-batch of the action log; per-epoch stats
    and feedback rows are written idempotently."""

    def handle(batch: DataFrame, epoch: int) -> None:
        _, fb, stats = FB.collect_feedback(batch, mailbox, as_of, days)
        write_epoch(stats, f"{out_dir}/stats", epoch)
        write_epoch(fb, f"{out_dir}/feedback", epoch)

    run_available(actions, checkpoint, handle)
    return spark.read.parquet(f"{out_dir}/stats")


def label_states(ops: DataFrame) -> DataFrame:
    """Streaming fold of label operations (message_id, seq, op, labels): the
    operation with the highest ``seq`` decides each (mail, label), so one
    that arrives late never undoes a newer one.  ``seq`` may be a struct
    (time, id).  ``store.labels_of_states`` turns the states into mail."""
    effects = ST.label_effects(ops)
    return effects.groupBy("message_id", "label").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
