"""Streaming jobs whose state and reads stay bounded.

* ``mailbox_states``: the fold of label operations with ``transformWithState``, whose states hold the mails
  of a hash bucket; what they hold of a mail that had no operation for a while expires.
* ``dedup_by_bucket``: each message once, checked against an id index of which only the buckets that a
  batch touches are read.
* ``closing_daily_volume``: messages per day; days close, rows that come later go to a table of their own.

Every job writes ``EpochLog`` tables, which replace a replayed epoch and are compacted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import store as ST
from .jobs import run_available
from .log import EpochLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMPACT_EVERY = 16  # epochs


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session with the state store that ``transformWithState`` needs; the caller's stays as it is.
    Timers fire in batches that have data: with batches without data a run over everything available
    would wait for timers for ever."""
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    s.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        s.conf.set(key, spark.conf.get(key))
    return s


# ---------------------------------------------------------------------------
# Mailbox state
# ---------------------------------------------------------------------------

CHANGES = "message_id string, label string, kind string, at bigint, id bigint"
MAIL_STATES = (  # of each mail when it may go and its number of labels; of each label, mail after mail, its last operation
    "mails array<string>, expires array<bigint>, counts array<int>, "
    "labels array<string>, kinds array<string>, ats array<bigint>, ids array<bigint>"
)
STATE_BUCKETS = 1 << 12


class LabelStates(StatefulProcessor):
    """Last operation on each label of the mails of a bucket.  A row goes out when it is newer than the
    state's; what the state holds of a mail goes ``keep_ms`` after the mail's last operation.  A call to the state
    costs far more than a row, so mails share it: a bucket's operations cost one read and one write.  A bucket
    has one timer, at the earliest time that a mail of it may go; when it fires it is set anew for those that stay."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("labels", MAIL_STATES)

    def _mails(self, value) -> dict[str | None, list]:
        """Of each mail: when it may go, and (at, id, kind) by label."""
        mails, expires, counts, *columns = value
        rows = zip(*columns, strict=True)
        return {m: [e, {label: (at, i, kind) for label, kind, at, i in islice(rows, n)}] for m, e, n in zip(mails, expires, counts, strict=True)}

    def _put(self, mails: dict[str | None, list]) -> None:
        known = [(label, kind, at, i) for _, labels in mails.values() for label, (at, i, kind) in labels.items()]
        columns = [list(c) for c in zip(*known, strict=True)]
        self.state.update((list(mails), [e for e, _ in mails.values()], [len(labels) for _, labels in mails.values()], *columns))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.state.get()
        mails = {} if before is None else self._mails(before)
        expires = timerValues.getCurrentProcessingTimeInMs() + self.keep_ms
        changed = set()
        for r in rows:
            mail, label, kind, at, i = r[:5]
            of_mail = mails.get(mail)
            if of_mail is None:
                of_mail = mails[mail] = [expires, {}]
            of_mail[0], known, seen = expires, of_mail[1], (int(at), int(i), kind)
            if label not in known or seen > known[label]:
                known[label] = seen
                changed.add((mail, label))
        if before is None:
            self.handle.registerTimer(expires)
        self._put(mails)
        for mail, label in changed:
            at, i, kind = mails[mail][1][label]
            yield Row(message_id=mail, label=label, kind=kind, at=at, id=i)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        value, now = self.state.get(), timerValues.getCurrentProcessingTimeInMs()
        mails = {} if value is None else self._mails(value)
        left = {m: of_mail for m, of_mail in mails.items() if of_mail[0] > now}
        if left:
            self.handle.registerTimer(min(e for e, _ in left.values()))
            if len(left) < len(mails):
                self._put(left)
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_states(changes: DataFrame) -> DataFrame:
    """The newest change of each (message_id, label).  Of two operations with the same time and id the
    removal counts."""
    newest = F.max_by(F.struct("kind", "at", "id"), F.struct("at", "id", "kind"))
    return changes.groupBy("message_id", "label").agg(newest.alias("s")).select("message_id", "label", "s.*")


def mailbox_states(
    ops: DataFrame, out_dir: str, checkpoint: str, keep_ms: int, compact_every: int = COMPACT_EVERY, buckets: int = STATE_BUCKETS
) -> DataFrame:
    """Run the fold of label operations (message_id, seq struct<at, id>, op, labels) over everything
    available; returns (message_id, label, kind, at, id), the newest operation of each label.

    The state only decides which rows need not be written: an operation older than one that the state
    holds.  Once a mail's state has expired, a late operation is written again, and the reader takes the
    newest by (time, id).  So expiry never changes the result, no operation is dropped, and a late one
    never undoes a newer one.  ``ops`` is read in a session of ``stateful_session``.

    Mails share a state by the hash of their id, ``buckets`` states in all, a number that a checkpoint must keep.
    A batch reads and writes the states of its mails' buckets."""
    spark = ops.sparkSession
    log = EpochLog(spark, out_dir, CHANGES)
    effects = ST.label_effects(ops).select("message_id", "label", "kind", F.col("seq.at").alias("at"), F.col("seq.id").alias("id"))
    effects = effects.withColumn("bucket", F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int"))  # the last column
    changes = effects.groupBy("bucket").transformWithState(
        statefulProcessor=LabelStates(keep_ms), outputStructType=CHANGES, outputMode="Update", timeMode="ProcessingTime"
    )

    def handle(batch: DataFrame, epoch: int) -> None:
        log.write(batch, epoch)
        if (epoch + 1) % compact_every == 0:
            log.compact(epoch, newest_states)

    run_available(changes, checkpoint, handle, "update")
    return newest_states(log.rows())


# ---------------------------------------------------------------------------
# Each message once
# ---------------------------------------------------------------------------


IDS = "message_id string, bucket int"


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def dedup_by_bucket(mail: DataFrame, out_dir: str, checkpoint: str, buckets: int = 1024, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Store each message once, however late it is delivered again.

    The ids stored so far lie in folders by hash bucket.  A batch reads the folders of its own buckets
    only (their numbers, at most ``buckets``, are a filter on the partition column), so a small batch
    reads little.  Mail without an id is one mail of its own, as in ``latest_mail``."""
    spark = mail.sparkSession
    ids = EpochLog(spark, f"{out_dir}/ids", IDS, ["bucket"])
    stored = EpochLog(spark, f"{out_dir}/mail", schema_of(mail))

    def handle(batch: DataFrame, epoch: int) -> None:
        new = ST.latest_mail(batch).withColumn("bucket", F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int")).persist()
        known = ids.rows(epoch)
        fresh = new
        if known is not None:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]
            mine = known.filter(F.col("bucket").isin(touched)).select("message_id", "bucket")
            same = new["message_id"].eqNullSafe(mine["message_id"]) & (new["bucket"] == mine["bucket"])
            fresh = new.join(mine, same, "left_anti")
        stored.write(fresh.drop("bucket"), epoch)
        written = stored.epoch(epoch).select("message_id", F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int").alias("bucket"))
        ids.write(written, epoch)
        new.unpersist()
        if (epoch + 1) % compact_every == 0:
            ids.compact(epoch, lambda rows: rows)

    run_available(mail, checkpoint, handle, "append")
    return stored.rows().drop("epoch")


# ---------------------------------------------------------------------------
# Days that close
# ---------------------------------------------------------------------------


def closing_daily_volume(mail: DataFrame, out_dir: str, checkpoint: str, delay_days: int = 2) -> tuple[DataFrame, DataFrame]:
    """Messages per day, with a watermark: (day, n, closed) and the late rows.

    A day closes once a message ``delay_days`` or more days newer than its end has been seen in an earlier
    batch.  A closed day's count does not change any more; a row of such a day goes to the late table
    instead, and so does a row without a date.  What a batch carries over is the open days' counts, a row
    for each day between the watermark and the newest day.  No row is lost: counts and late rows together
    are the mail."""
    spark = mail.sparkSession
    counted = "day timestamp_ntz, n bigint"
    tables = {"marks": "mark timestamp_ntz", "open": counted, "closed": counted, "late": schema_of(mail)}
    marks, still_open, closed, late = (EpochLog(spark, f"{out_dir}/{name}", schema) for name, schema in tables.items())

    def handle(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("_day", F.date_trunc("day", F.col("date").cast("timestamp_ntz"))).persist()
        last = marks.last(epoch)
        mark = marks.epoch(last).first()["mark"] if last is not None else None
        passed = F.col("_day").isNull() if mark is None else F.col("_day").isNull() | (F.col("_day") < F.lit(mark).cast("timestamp_ntz"))
        late.write(rows.filter(passed).drop("_day"), epoch)
        counts = rows.filter(~passed).groupBy(F.col("_day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
        if last is not None:
            counts = counts.unionByName(still_open.epoch(last))
        counts = counts.groupBy("day").agg(F.sum("n").alias("n"))
        newest = rows.agg((F.max("_day") - F.expr(f"INTERVAL {int(delay_days)} DAYS")).alias("mark"))
        new_mark = newest.select(F.greatest("mark", F.lit(mark).cast("timestamp_ntz")).alias("mark"))
        marks_row = new_mark.first()["mark"]
        closing = F.lit(False) if marks_row is None else F.col("day") < F.lit(marks_row).cast("timestamp_ntz")
        closed.write(counts.filter(closing), epoch)
        still_open.write(counts.filter(~closing), epoch)
        # Last: a mark says that the epoch's other tables are there.
        marks.write(new_mark, epoch)
        rows.unpersist()

    run_available(mail, checkpoint, handle, "append")
    days = closed.rows().select("day", "n", F.lit(True).alias("closed"))
    days = days.unionByName(still_open.epoch(still_open.last()).select("day", "n", F.lit(False).alias("closed")))
    return days, late.rows().drop("epoch")


def volume_with_late(days: DataFrame, late: DataFrame) -> DataFrame:
    """Messages per day, late ones included (day, n)."""
    more = late.filter("date is not null").groupBy(F.date_trunc("day", F.col("date").cast("timestamp_ntz")).alias("day"))
    more = more.agg(F.count(F.lit(1)).alias("n"))
    return days.select("day", "n").unionByName(more).groupBy("day").agg(F.sum("n").alias("n"))
