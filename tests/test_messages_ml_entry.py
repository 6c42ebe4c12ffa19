"""Raw-message normalisation, ML helpers, persistence and the driver entry."""

import base64
import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sortbox.operators import ml as ML
from sortbox.operators import store as ST
from sortbox.sources import messages as MS
from sortbox.plans.q_stream import stage_files
from sortbox.streaming import jobs as SJ

NOW = dt.datetime(2024, 6, 1)


def _b64(s):
    return base64.urlsafe_b64encode(s.encode()).decode()


def _raw(spark, msgs):
    return spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(msgs)], "raw_id long, json string")


def test_normalize_message_shapes(spark):
    msg = {
        "id": "x1",
        "threadId": "t1",
        "labelIds": ["INBOX"],
        "payload": {
            "headers": [
                {"name": "Subject", "value": "old"},
                {"name": "From", "value": "=?utf-8?b?" + base64.b64encode("Zoë".encode()).decode() + "?= <z@ex.org>"},
                {"name": "subject", "value": "new"},
                {"name": "Date", "value": "Mon, 15 Jan 2024 14:30:00 -0500"},
            ],
            "mimeType": "multipart/mixed",
            "parts": [
                {"mimeType": "text/plain", "body": {"data": "abc"}},  # broken padding -> ''
                {"mimeType": "multipart/alternative", "parts": [
                    {"mimeType": "text/html", "body": {"data": _b64("<b>h</b>")}},
                    {"mimeType": "text/plain", "body": {"data": _b64("plain body")}},
                ]},
            ],
        },
    }
    bad = {"threadId": "t2"}
    out, q = MS.normalize_messages(_raw(spark, [msg, bad]), F.lit(NOW).cast("timestamp_ntz"))
    r = out.first()
    assert r.subject == "new"  # last duplicate header wins
    assert (r.from_name, r.from_address) == ("Zoë", "z@ex.org")
    assert r.date == dt.datetime(2024, 1, 15, 14, 30)  # zone dropped, wall clock kept
    assert r.body_plain == "plain body" and r.body_html == "<b>h</b>"
    assert r.snippet == "" and not r.was_archived and r.was_read
    assert q.count() == 1


def test_normalize_defaults(spark):
    msg = {"id": "x", "threadId": "t", "payload": {"headers": [{"name": "From", "value": "bare@ex.org"}]}}
    r = MS.normalize_messages(_raw(spark, [msg]), F.lit(NOW).cast("timestamp_ntz"))[0].first()
    assert r.subject == "(No Subject)" and r.labels == [] and r.date == NOW
    assert (r.from_name, r.from_address, r.to_address) == ("", "bare@ex.org", "")


def test_combine_embeddings(spark):
    df = spark.createDataFrame([([0.2, 0.4], [0.4, 0.6]), ([1.0], None), (None, []), ([1.0, 2.0, 3.0], [3.0])], "s array<double>, b array<double>")
    got = [r.c for r in df.select(ML.combine_embeddings(F.col("s"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx([0.3, 0.5]) and got[1] == [1.0] and got[2] is None and got[3] == [2.0]


def test_training_matrix_fill_rules(spark):
    em = spark.createDataFrame([("a", True), ("b", False)], "message_id string, was_read boolean")
    feats = spark.createDataFrame(
        [("a", 3, None, None, None, None, None, None, None, None, None, None),
         ("b", 1, 0.5, 2.0, 0.1, True, 1, 2, 3, 4, None, None)],
        "message_id string, sender_email_count int, sender_open_rate double, sender_days_since_last double, "
        "domain_open_rate double, is_newsletter boolean, day_of_week int, hour_of_day int, subject_length int, body_length int, "
        "subject_embedding array<double>, body_embedding array<double>",
    )
    m = ML.training_matrix(em, feats, use_embeddings=False, min_sender_count=2).collect()
    assert len(m) == 1
    r = m[0]
    assert r.sender_days_since_last == 999.0 and r.sender_open_rate == 0.0 and r.is_newsletter == 0.0 and r.y == 1


def test_stratified_split_exact_and_stable(spark):
    df = spark.range(1000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = ML.stratified_split(df, "y", 0.2, buckets=16)
    counts = {r.y: r.n for r in a.filter("is_test").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {1: 67, 0: 134}  # ceil(0.2 * 334), ceil(0.2 * 666)
    b = ML.stratified_split(df.repartition(7), "y", 0.2, buckets=16)
    assert sorted(r.message_id for r in a.filter("is_test").collect()) == sorted(r.message_id for r in b.filter("is_test").collect())


def test_model_and_metrics_persistence(spark):
    rows = [(f"m{i}", float(i % 7), float(i % 5), float(i % 2), 1.0, 2.0, 3.0, float(i), 0.5, 999.0, 0.2, i % 2) for i in range(60)]
    df = spark.createDataFrame(
        rows,
        "message_id string, is_newsletter double, day_of_week double, hour_of_day double, subject_length double, body_length double, "
        "sender_email_count double, sender_open_rate double, sender_days_since_last double, domain_open_rate double, x double, y int",
    ).drop("x")
    model, test, metrics = ML.train_importance_model(df, max_iter=5)
    base = tempfile.mkdtemp(prefix="sortbox-model-")
    ML.save_model(model, base, "v1", ML.feature_columns(df))
    ML.save_model(model, base, "v2", ML.feature_columns(df))
    loaded, names = ML.load_model(spark, base)
    assert names == ML.feature_columns(df)
    assert ML.score_rows(loaded, df).count() == 60
    ML.save_metrics(metrics, f"{base}/metrics")
    assert set(ML.load_metrics(spark, f"{base}/metrics").columns) >= {"auc", "precision", "recall"}


def test_mailbox_state_stream_equals_batch_fold(spark):
    em = spark.createDataFrame([("m1", ["INBOX", "UNREAD"]), ("m2", ["INBOX"])], "message_id string, labels array<string>")
    ops = spark.createDataFrame(
        [("m1", 1, "archive", []), ("m1", 5, "move_to_inbox", []), ("m2", 2, "add_labels", ["X"]), ("m1", 7, "mark_read", []),
         ("m2", 9, "remove_labels", ["INBOX"])],
        "message_id string, seq long, op string, labels array<string>",
    )
    init = em.select("message_id", F.lit(-1).cast("long").alias("seq"), F.lit("init").alias("op"), "labels")
    allops = init.unionByName(ops)
    base = tempfile.mkdtemp(prefix="sortbox-stream-")
    # m1's archive (1) and m2's add (2) arrive after the newer operations.
    arrival = F.when(F.col("seq").isin(1, 2), F.col("seq") + 100).otherwise(F.col("seq"))
    sent = allops.withColumn("arrived", arrival)
    stage_files(sent, f"{base}/ops", "arrived", 3)
    SJ.run_updates(SJ.label_states(SJ.file_stream(spark, f"{base}/ops", sent.schema, 1)), f"{base}/out", f"{base}/ckpt")
    states = SJ.latest_rows(spark, f"{base}/out", ["message_id", "label"])
    got = {r.message_id: r.labels for r in ST.labels_of_states(states).collect()}
    want = {r.message_id: r.labels for r in ST.apply_label_ops(em, ops).collect()}
    assert got == want


def test_entry_and_registry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total == 200
    assert rows[0].high_keep + rows[0].high_archive + rows[0].low_confidence == rows[0].total
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
