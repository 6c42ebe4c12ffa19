"""Streams with bounded state, bucketed upserts, vectors stored by content."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from sortbox.operators import buckets as BU
from sortbox.operators import embedding_store as ES
from sortbox.operators import ml as ML
from sortbox.operators import store as ST
from sortbox.plans.q_stream import stage_files
from sortbox.session import scratch_path
from sortbox.streaming import bounded as SB
from sortbox.streaming import jobs as SJ
from sortbox.streaming.log import EpochLog

OPS = "message_id string, seq struct<at: bigint, id: bigint>, op string, labels array<string>, arrived bigint"


def scratch(spark):
    return scratch_path(spark, f"bounded-{uuid.uuid4().hex}")


def files_of(path):
    import pathlib

    return {str(f): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("keep_ms", [1, 10**9])
def test_mailbox_states_equal_the_batch_fold_and_expire(spark, keep_ms):
    base = scratch(spark)
    em = spark.createDataFrame([("m1", ["INBOX", "UNREAD"]), ("m2", ["INBOX"])], "message_id string, labels array<string>")
    ops = [
        ("m1", (5, 1), "move_to_inbox", [], 10), ("m1", (7, 2), "mark_read", [], 11), ("m2", (9, 3), "remove_labels", ["INBOX"], 12),
        ("m1", (1, 4), "archive", [], 20), ("m2", (2, 5), "add_labels", ["X", "INBOX"], 21),  # late: older than what came before
        ("m1", (8, 6), "add_labels", ["Y"], 30), ("m1", (7, 2), "mark_read", [], 31),  # repeated
    ]
    init = em.select("message_id", F.expr("named_struct('at', -1L, 'id', -1L)").alias("seq"), F.lit("init").alias("op"), "labels", F.lit(0).cast("long").alias("arrived"))
    sent = init.unionByName(spark.createDataFrame(ops, OPS))
    stage_files(sent, f"{base}/ops", "arrived", 4)
    stream = SJ.file_stream(SB.stateful_session(spark), f"{base}/ops", sent.schema, 1)
    SB.mailbox_states(stream, f"{base}/out", f"{base}/ckpt", keep_ms, compact_every=2)
    states = SB.newest_states(EpochLog(spark, f"{base}/out", SB.CHANGES).rows())
    got = {r.message_id: r.labels for r in ST.labels_of_states(states).collect()}
    want = {r.message_id: r.labels for r in ST.apply_label_ops(em, spark.createDataFrame(ops, OPS)).collect()}
    assert got == want == {"m1": ["INBOX", "Y"], "m2": ["X"]}
    left = SB.stateful_session(spark).read.format("statestore").option("stateVarName", "labels").load(f"{base}/ckpt").count()
    assert left == 2 if keep_ms > 1 else left < 2


def test_ids_are_read_by_touched_bucket(spark, monkeypatch):
    base = scratch(spark)
    rows = [(f"m{i}", dt.datetime(2024, 1, 1 + i), i) for i in range(12)]
    rows += [(f"m{i}", dt.datetime(2024, 1, 1 + i), 20 + i) for i in range(0, 12, 2)] + [(None, dt.datetime(2024, 1, 1), 3), (None, dt.datetime(2024, 1, 1), 40)]
    sent = spark.createDataFrame(rows, "message_id string, date timestamp_ntz, arrived int")
    stage_files(sent, f"{base}/mail", "arrived", 6)
    out = SB.dedup_by_bucket(SJ.file_stream(spark, f"{base}/mail", sent.schema, 1), f"{base}/out", f"{base}/ckpt", buckets=8, compact_every=2)
    ids = [r.message_id for r in out.collect()]
    assert sorted(map(str, ids)) == sorted(["None", *(f"m{i}" for i in range(12))])
    log = EpochLog(spark, f"{base}/out/ids", SB.IDS, ["bucket"])
    assert len(log._numbers("bases")) <= 2 and len(log._numbers("epochs")) <= 4  # compacted
    assert "PartitionFilters: [bucket#" in log.rows().filter(F.col("bucket").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()


def test_a_replayed_epoch_replaces_its_rows_and_reads_what_it_read(spark):
    log = EpochLog(spark, scratch(spark), "x int")
    assert log.rows() is None and log.last() is None
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    total = lambda rows: rows.agg(F.sum("x").cast("int").alias("x"))
    for e in range(7):
        assert (log.rows(e) is None) == (e == 0)
        log.write(frame(e, 10), e)
        if e % 2:
            log.compact(e, total)
    want = sum(range(7)) + 70
    assert log.rows().agg(F.sum("x")).first()[0] == want
    assert log.rows(5).agg(F.sum("x")).first()[0] == sum(range(5)) + 50  # as epoch 5 read it before its base was written
    log.write(frame(6, 10), 6)
    assert log.rows().agg(F.sum("x")).first()[0] == want
    assert min(log._numbers("epochs")) > 1


def test_days_close_and_late_rows_are_kept(spark):
    base = scratch(spark)
    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    rows = [("a", day(1), 0), ("b", day(2), 0), ("c", day(5), 1), ("late", day(1), 2), ("open", day(4), 2), ("none", None, 2), ("d", day(9), 3), ("last", day(6), 4), ("e", day(9), 4)]
    sent = spark.createDataFrame(rows, "message_id string, date timestamp_ntz, arrived int")
    stage_files(sent, f"{base}/mail", "arrived", 5)
    days, late = SB.closing_daily_volume(SJ.file_stream(spark, f"{base}/mail", sent.schema, 1), f"{base}/out", f"{base}/ckpt")
    # brute force over the same files
    import pathlib

    seen, mark, counts, missed = None, None, {}, []
    for f in sorted(pathlib.Path(f"{base}/mail").glob("part-*"), key=lambda p: p.stat().st_mtime):
        part = [(r.message_id, r.date) for r in spark.read.parquet(str(f)).collect()]
        for i, d in part:
            if d is None or (mark and d.date() < mark):
                missed.append(i)
            else:
                counts[d.date()] = counts.get(d.date(), 0) + 1
        for _, d in part:
            seen = max(filter(None, (seen, d and d.date())), default=None)
        mark = seen and seen - dt.timedelta(days=2)
    assert {r.day.date(): (r.n, r.closed) for r in days.collect()} == {d: (n, d < mark) for d, n in counts.items()}
    assert sorted(r.message_id for r in late.collect()) == sorted(missed) and "none" in missed and len(missed) > 1
    assert SB.volume_with_late(days, late).agg(F.sum("n")).first()[0] == len(rows) - 1


def test_upsert_rewrites_touched_buckets_only(spark):
    path = scratch(spark)
    table = spark.createDataFrame([(f"m{i}", i) for i in range(200)], "message_id string, v int")
    BU.write_bucketed(table, path, buckets=16)
    before = files_of(path)

    def upsert(old, new):
        return old.join(new.select("message_id"), "message_id", "left_anti").unionByName(new)

    inc = spark.createDataFrame([("m3", -3), ("new", 7)], "message_id string, v int")
    touched = BU.upsert_bucketed(path, inc, upsert, buckets=16)
    after = files_of(path)
    assert 1 <= len(touched) <= 2
    assert {f for f in before if f in after and before[f] == after[f]} == {f for f in before if int(f.split("bucket_of_16=")[1].split("/")[0]) not in touched}
    got = {r.message_id: r.v for r in BU.read_bucketed(spark, path, 16).collect()}
    assert got == {f"m{i}": i for i in range(200)} | {"m3": -3, "new": 7}
    assert BU.upsert_bucketed(path, inc.filter(F.lit(False)), upsert, buckets=16) == []
    with pytest.raises(Exception, match="boom"):
        BU.upsert_bucketed(path, inc, lambda old, new: old.withColumn("v", F.raise_error(F.lit("boom")).cast("int")), buckets=16)
    assert {f: t for f, t in files_of(path).items() if ".spark-staging" not in f} == after


def test_each_text_is_encoded_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def factory():
        def encode(texts):
            with open(calls, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[float(len(t)), float(ord(t[0]))] for t in texts]

        return encode

    rows = [("a", "same", "body"), ("b", "same", None), ("c", "  ", "same"), ("d", None, "other  text")]
    mail = spark.createDataFrame(rows, "message_id string, subject string, body string")
    table, cols = scratch(spark), {"subject": "sv", "body": "bv"}
    out = ES.embed_by_content(mail, cols, "m1", table, factory).orderBy("message_id").collect()
    direct = ML.embed_text(ML.embed_text(mail, "subject", "sv", factory), "body", "bv", factory).orderBy("message_id")
    n = len(calls.read_text().splitlines())
    assert n == 3
    assert [tuple(r) for r in out] == [tuple(r) for r in direct.collect()]
    calls.write_text("")
    more = mail.unionByName(spark.createDataFrame([("e", "new", "same")], mail.schema))
    assert ES.embed_by_content(more, cols, "m1", table, factory).count() == 5
    assert calls.read_text().splitlines() == ["new"]
    ES.embed_by_content(mail, cols, "m2", table, factory).collect()
    assert len(calls.read_text().splitlines()) == 4  # another encoder has vectors of its own
    assert ES.embed_by_content(mail.filter(F.lit(False)), cols, "m1", table, factory).collect() == []


def test_an_operation_reads_and_writes_the_state_once():
    from pyspark.sql import Row

    class Handle:
        def __init__(self):
            self.value, self.calls = None, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.calls.append("clear")
            self.value = None

        def registerTimer(self, at):
            self.calls.append(f"timer {at}")

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentProcessingTimeInMs(self):
            return self.ms

    h, p = Handle(), SB.LabelStates(100)
    p.init(h)
    row = lambda label, kind, at, i: Row(message_id="m", label=label, kind=kind, at=at, id=i)
    out = list(p.handleInputRows(("m",), iter([row("A", "add", 1, 1), row(None, "add", 1, 1)]), Now(0)))
    assert {tuple(r) for r in out} == {("m", "A", "add", 1, 1), ("m", None, "add", 1, 1)} and h.calls == ["get", "timer 100", "update"]
    h.calls.clear()
    out = list(p.handleInputRows(("m",), iter([row("A", "remove", 5, 2), row(None, "add", 0, 9)]), Now(60)))
    assert [tuple(r) for r in out] == [("m", "A", "remove", 5, 2)] and h.calls == ["get", "update"]
    h.calls.clear()
    assert list(p.handleExpiredTimer(("m",), Now(100), None)) == [] and h.calls == ["get", "timer 160"]
    assert list(p.handleExpiredTimer(("m",), Now(160), None)) == [] and h.value is None
