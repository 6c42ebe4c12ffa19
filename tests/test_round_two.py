"""Repeated mail, appended logs, deep MIME, odd dates, NaN scores, one class, inference on all rows."""

import base64
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sortbox.functions import columns as C
from sortbox.functions import mime as M
from sortbox.operators import evaluation as EV
from sortbox.operators import feedback as FB
from sortbox.operators import labels as LB
from sortbox.operators import ml as ML
from sortbox.operators import store as ST
from sortbox.plans import triage as TR
from sortbox.plans.q_features import built_features
from sortbox.session import ensure_checkpoint_dir
from sortbox.sources import bridge as B
from sortbox.sources import messages as MS

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 2, 1)


def test_triage_decides_once_for_a_message_delivered_again(spark):
    em = B.emails(spark, SF)
    cut = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    incoming = em.filter(F.col("date") >= cut).select(*ST.EMAIL_COLUMNS)
    again = incoming.unionByName(incoming.limit(3)).unionByName(incoming.limit(3))
    store = built_features(spark, SF)
    scorer = lambda df: df.select("message_id", F.lit(0.5).alias("score"))
    bad = spark.createDataFrame([("{",), ("[]",)], "json string")
    r = TR.triage(em.filter(F.col("date") < cut), again, store, B.sender_label_mappings(spark), scorer, NOW, failed=bad)
    n = incoming.count()
    assert r["decisions"].count() == n == r["decisions"].select("message_id").distinct().count()
    assert r["emails"].count() == em.count()
    assert (r["summary"].first().errors, r["summary"].first().total) == (2, n + 2)


def test_appended_log_feeds_the_feedback_jobs(spark):
    a = B.email_actions(spark, SF)
    new = spark.createDataFrame([("m1", "archive"), ("m2", "keep")], "message_id string, action_type string")
    log = ST.append_action(a, new, NOW)
    assert log.columns == a.columns and log.count() == a.count() + 2
    added = log.filter(F.col("timestamp") == F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).collect()
    assert {(r.message_id, r.source, r.action_data.score) for r in added} >= {("m1", "user", None), ("m2", "user", None)}
    assert len({r.action_id for r in added}) == len(added)
    assert FB.collect_feedback(log, B.emails(spark, SF), NOW, 30)[2].first().bot_actions > 0
    with pytest.raises(ValueError):
        ST.append_action(a, new)
    f = B.feedback_reviews(spark, SF)
    out = ST.append_feedback(f, spark.createDataFrame([("m1", NOW)], "message_id string, review_date timestamp_ntz"))
    assert out.columns == f.columns and out.filter("review_id is null").count() == 0
    s = B.semantic_labels(spark, SF)
    assert ST.append_semantic_labels(s, new.select("message_id", F.lit("L").alias("label")), "m").columns == s.columns


def test_upserts_keep_one_row_per_id(spark):
    schema = "message_id string, subject_length int"
    feats = spark.createDataFrame([("a", 1, NOW)], schema + ", computed_at timestamp_ntz")
    out = ST.upsert_features(feats, spark.createDataFrame([("b", 2), ("b", 2), ("a", 5)], schema), ["subject_length"], feats.columns, NOW)
    assert sorted((r.message_id, r.subject_length) for r in out.collect()) == [("a", 5), ("b", 2)]


def _nested(depth):
    part = {"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(b"deep body").decode()}}
    for _ in range(depth):
        part = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/html", "body": {"data": ""}}, part]}
    return json.dumps({"id": "x", "threadId": "t", "payload": {"headers": [], **part}})


@pytest.mark.parametrize("depth", [0, 5, 6, 7, 10, 200])
def test_bodies_at_any_depth(spark, depth):
    raw = spark.createDataFrame([(_nested(depth),)], "json string")
    good, _ = MS.normalize_messages(raw, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert good.first().body_plain == "deep body"


def test_mail_dates_in_a_zone_with_a_missing_hour(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [("10 Mar 2024 02:30:00 -0500",), ("15 Jan 24 10:00:00 +0000",), ("Mon, 15 January 2024 10:00 GMT",), ("1 Feb 99 1:02:03",), ("no date",)]
        d = spark.createDataFrame(rows, "h string")
        got = [r[0] for r in d.select(M.parse_mail_date(F.col("h"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 1, 15, 10), dt.datetime(2024, 1, 15, 10), dt.datetime(1999, 2, 1, 1, 2, 3), dt.datetime(2000, 1, 1)]


def test_small_columns(spark):
    d = spark.createDataFrame([("aGVs\r\nbG8=", "it&#8217;s &hellip; &eacute;", None)], "b string, s string, a string")
    r = d.select(M.decode_base64url(F.col("b")).alias("b"), C.review_snippet("s").alias("s"), LB.is_work_email("a", "a").alias("w")).first()
    assert (r.b, r.s, r.w) == ("hello", "it’s … é", False)
    long = spark.createDataFrame([("word " * 1000,)], "t string")
    assert len(long.select(C.prepare_text("t")).first()[0]) == 4999 and len(long.select(C.prepare_text("t", 100)).first()[0]) == 100


def test_nan_scores_and_one_class(spark):
    d = spark.createDataFrame([(1, float("nan")), (0, 0.9), (1, 0.8)], "y int, score double")
    r = EV.evaluate(d, 0.5).first()
    assert (r.true_positives, r.false_negatives, r.false_positives) == (1, 1, 1)
    t = EV.threshold_metrics(d, 0.5).first()
    assert (t.tp, t.fn) == (1, 1)
    s = EV.threshold_sweep(d, [0.5], with_auc=False).first()
    assert (s.tp, s.fn) == (1, 1)
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, score double")
    assert all(p.fpr is None for p in EV.roc_curve(one).collect() if p.threshold != float("inf"))
    assert EV.score_summary(one.limit(0)).first().accuracy is None


def test_every_feature_row_is_scored(spark):
    rows = [("a", [1.0, 2.0], None), ("b", None, None), ("c", [1.0], [3.0])]
    f = spark.createDataFrame(rows, "message_id string, subject_embedding array<double>, body_embedding array<double>")
    for c in [*ML.METADATA_FEATURES, *ML.HISTORICAL_FEATURES]:
        f = f.withColumn(c, F.lit(None).cast("double"))
    m = {r.message_id: r for r in ML.inference_matrix(f, 2).collect()}
    assert {k: r.emb for k, r in m.items()} == {"a": [1.0, 2.0], "b": [0.0, 0.0], "c": [2.0, 0.0]}
    assert m["a"].sender_days_since_last == ML.NO_PREVIOUS_DAYS and m["a"].sender_email_count == 0


def test_bodies_are_embedded_with_the_snippet_as_fallback(spark):
    d = spark.createDataFrame([("a", "s", "", "a  snippet"), ("b", "s", None, None)], "message_id string, subject string, body_plain string, snippet string")
    plain = spark.createDataFrame([("a", "s", " a snippet ", None)], d.schema)
    one, two = (ML.embed_mail(x, dims=16).filter("message_id = 'a'").first() for x in (d, plain))
    assert one.body_embedding == two.body_embedding and sum(one.body_embedding) > 0
    assert ML.embed_mail(d, dims=16).filter("message_id = 'b'").first().body_embedding is None
    encoder = lambda: lambda texts: [[float(len(t))] for t in texts]
    assert ML.embed_mail(d, encoder).filter("message_id = 'a'").first().body_embedding == [9.0]


def test_a_cluster_without_a_shared_folder_fails():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
