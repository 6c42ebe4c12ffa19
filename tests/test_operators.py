"""Relational operators: stats, history, labels, feedback, stores."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sortbox.operators import features as FE
from sortbox.operators import feedback as FB
from sortbox.operators import history as H
from sortbox.operators import labels as LB
from sortbox.operators import store as ST
from sortbox.plans import triage as TR

T0 = dt.datetime(2024, 1, 1)


def _mail(spark, rows):
    return spark.createDataFrame(
        rows, "message_id string, from_address string, date timestamp_ntz, was_read boolean, was_archived boolean"
    )


def test_sender_stats(spark):
    em = _mail(
        spark,
        [("a", "s@x.com", T0, True, False), ("b", "s@x.com", T0, True, True), ("c", "s@x.com", T0, False, True)],
    )
    r = FE.sender_stats(em).first()
    assert (r.total_emails, r.read_count, r.archived_count) == (3, 2, 2)
    assert r.open_rate == pytest.approx(2 / 3) and r.archive_rate == pytest.approx(2 / 3)
    unknown = FE.sender_stats_for(spark.createDataFrame([("nobody@x",)], "from_address string"), em).first()
    assert (unknown.total_emails, unknown.open_rate) == (0, 0.0)


def test_domain_stats_case_insensitive(spark):
    em = _mail(spark, [("a", "a@X.com", T0, True, False), ("b", "b@x.COM", T0, False, False), ("c", "nodomain", T0, True, False)])
    rows = {r.domain: r for r in FE.domain_stats(em).collect()}
    assert set(rows) == {"x.com"} and rows["x.com"].domain_open_rate == 0.5


def _brute_prev(rows):
    out = {}
    for mid, k, t in rows:
        earlier = [u for _, kk, u in rows if kk == k and u < t]
        out[mid] = max(earlier) if earlier else None
    return out


def test_previous_email_hot_key_across_buckets(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        k = "hot" if i % 3 else f"k{i % 7}"
        rows.append((f"m{i}", k, T0 + dt.timedelta(minutes=rnd.randint(0, 3000))))
    df = spark.createDataFrame(rows, "message_id string, from_address string, date timestamp_ntz")
    got = {r.message_id: r.prev_date for r in FE.previous_email(df, bucket_seconds=3600).collect()}
    assert got == _brute_prev(rows)
    probes = df.filter(F.col("message_id").endswith("1"))
    got2 = {r.message_id: r.prev_ts for r in H.asof_max_before(df, probes, "from_address", "date", "message_id", 1800).collect()}
    want = _brute_prev(rows)
    assert got2 == {m: want[m] for m in got2} and len(got2) == probes.count()


def test_keyed_running_sum(spark):
    rows = [(k, i, T0 + dt.timedelta(hours=i), 1 + i % 3) for i in range(60) for k in ("a", "b") if (i + len(k)) % 2 or k == "a"]
    df = spark.createDataFrame(rows, "k string, i int, d timestamp_ntz, v int").withColumn("b", H.time_bucket(F.col("d"), 7200))
    got = {(r.k, r.i): r.run_v for r in H.keyed_running_sum(df, ["k"], "b", [F.col("d"), F.col("i")], ["v"]).collect()}
    for k, i, _, _ in rows:
        assert got[(k, i)] == sum(v for kk, ii, _, v in rows if kk == k and ii <= i)


def test_sequential_history_visibility(spark):
    cols = "message_id string, from_address string, date timestamp_ntz, was_read boolean, was_archived boolean"
    committed = spark.createDataFrame(
        [("old1", "s@x.com", T0, True, False), ("re", "s@x.com", T0 + dt.timedelta(days=1), False, False)], cols
    )
    incoming = spark.createDataFrame(
        [
            ("new1", "s@x.com", T0 + dt.timedelta(days=3), True, False),  # processed first (newest)
            ("re", "s@x.com", T0 + dt.timedelta(days=1), True, False),  # re-triaged, now read
            ("first", "brand@new.org", T0 + dt.timedelta(days=2), False, False),
        ],
        cols,
    )
    h = {r.message_id: r for r in TR.sequential_history(committed, incoming, 86400).collect()}
    # new1 sees old1 and the stored version of re; not itself
    assert h["new1"].sender_email_count == 2 and h["new1"].sender_open_rate == pytest.approx(0.5)
    # re sees old1, new1 (processed earlier) and itself with new values
    assert h["re"].sender_email_count == 3 and h["re"].sender_open_rate == pytest.approx(1.0)
    assert h["first"].sender_email_count == 0 and h["first"].sender_open_rate == 0.0
    assert h["new1"].sender_days_since_last == pytest.approx(2.0)


def test_fallback_and_categories(spark):
    df = spark.createDataFrame(
        [("Your receipt",), ("Build alert",), ("50% off today",), ("hello",)], "subject string"
    ).withColumn("snippet", F.lit(""))
    got = [
        r.s.label
        for r in df.select(LB.fallback_suggestion(LB.category_text(), F.lit(False)).alias("s")).collect()
    ]
    assert got == ["Bot/Receipts", "Bot/Automated", "Bot/Promotional", "Bot/Personal"]
    # plain substring: 'ai' inside 'mailing'
    assert df.select(F.lit("mailing").contains("ai").alias("x")).first().x


def test_suggestion_waterfall(spark):
    sug = lambda lab, k: LB.suggestion(F.lit(lab), k, 0.5, "r")
    df = spark.range(1)
    learned = df.select(
        LB.suggestions_column(F.lit("Bot/Mine"), F.lit(None).cast(LB.SUGGESTION_TYPE), sug("Bot/A", 2), sug("Bot/B", 3), sug("Bot/C", 5)).alias("s")
    ).first().s
    assert [x.label for x in learned] == ["Bot/Mine"]
    s = df.select(
        LB.suggestions_column(
            F.lit(None).cast("string"), F.lit(None).cast(LB.SUGGESTION_TYPE), sug("Bot/A", 2), sug("Bot/A", 3), sug("Bot/Personal", 5)
        ).alias("s")
    ).first().s
    # sender label equal to the first suggestion is dropped; sorted by specificity
    assert [(x.label, x.specificity) for x in s] == [("Bot/A", 2), ("Bot/Personal", 5)]


def test_review_queue_order(spark):
    rows = [(1, '{"score": 0.8}'), (2, '{"score": 0.45}'), (3, '{"score": 0.1}'), (4, '{"score": 0.52}'), (5, '{"score": 0.3}'),
            (6, '{"labels": []}'), (7, '{"score": "invalid"}'), (8, '{"score": "0.5"}')]
    df = spark.createDataFrame(rows, "action_id long, action_json string")
    order = [r.action_id for r in FB.review_queue(df).collect()]
    assert order == [4, 2, 5, 1, 3, 6, 7, 8]


def test_collect_feedback(spark):
    acts = spark.createDataFrame(
        [(1, "m1", "archive", "bot", T0, ["Bot/A"]), (2, "gone", "archive", "bot", T0, []), (3, "m2", "keep", "bot", T0, ["Bot/B"])],
        "action_id long, message_id string, action_type string, source string, timestamp timestamp_ntz, labels array<string>",
    ).select("action_id", "message_id", "action_type", "source", "timestamp", F.struct(F.col("labels").alias("labels")).alias("action_data"))
    box = spark.createDataFrame([("m1", ["INBOX", "Bot/A"]), ("m2", ["Bot/C"])], "message_id string, labels array<string>")
    _, fb, stats = FB.collect_feedback(acts, box, T0 + dt.timedelta(hours=1), 1)
    s = stats.first()
    assert (s.bot_actions, s.false_positives, s.label_changes, s.verified_correct) == (3, 1, 1, 0)
    assert fb.first().correct_decision == "keep"


def test_apply_label_ops_last_write_wins(spark):
    em = spark.createDataFrame([("m", ["INBOX", "UNREAD"])], "message_id string, labels array<string>")
    ops = spark.createDataFrame(
        [("m", 1, "archive", None), ("m", 2, "add_labels", ["X"]), ("m", 3, "move_to_inbox", None), ("m", 4, "mark_read", None),
         ("m", 5, "remove_labels", ["X", "nope"])],
        "message_id string, seq int, op string, labels array<string>",
    )
    r = ST.apply_label_ops(em, ops).first()
    assert r.labels == ["INBOX"] and r.was_read and not r.was_archived


def test_upsert_emails_preserves_collected_at(spark):
    cols = ST.EMAIL_COLUMNS
    base = {c: None for c in cols}

    def row(mid, subj):
        d = dict(base, message_id=mid, subject=subj, labels=[], was_read=False, was_archived=False, is_important=False, is_starred=False, date=T0)
        return tuple(d[c] for c in cols)

    schema = ("message_id string, thread_id string, from_address string, from_name string, to_address string, subject string, "
              "date timestamp_ntz, snippet string, body_plain string, body_html string, labels array<string>, was_read boolean, "
              "was_archived boolean, is_important boolean, is_starred boolean")
    old = spark.createDataFrame([row("a", "old")], schema).withColumn("opened_at", F.lit(T0).cast("timestamp_ntz")).withColumn(
        "collected_at", F.lit(T0).cast("timestamp_ntz")
    )
    new = spark.createDataFrame([row("a", "new"), row("b", "fresh")], schema)
    now = dt.datetime(2024, 5, 1)
    out = {r.message_id: r for r in ST.upsert_emails(old, new, now).collect()}
    assert out["a"].subject == "new" and out["a"].collected_at == T0 and out["a"].opened_at == T0
    assert out["b"].collected_at == now and out["b"].opened_at is None


def test_upsert_features_explicit_null_overwrites(spark):
    feats = spark.createDataFrame([("a", 5, 1.0, T0)], "message_id string, subject_length int, sender_open_rate double, computed_at timestamp_ntz")
    upd = spark.createDataFrame([("a", None), ("b", 3)], "message_id string, subject_length int")
    now = dt.datetime(2024, 5, 1)
    out = {r.message_id: r for r in ST.upsert_features(feats, upd, ["subject_length", "bogus"], feats.columns, now).collect()}
    assert out["a"].subject_length is None and out["a"].sender_open_rate == 1.0 and out["a"].computed_at == now
    assert out["b"].subject_length == 3 and out["b"].sender_open_rate is None


def test_upsert_sender_mapping(spark):
    m = spark.createDataFrame([(1, "a@x", None, "L1", "user"), (2, None, "x", "L2", "user")],
                              "mapping_id long, sender_address string, sender_domain string, label string, source string")
    upd = spark.createDataFrame([("a@x", None, "L3", 1), (None, "y", "L4", 2), (None, "x", "L5", 3)],
                                "sender_address string, sender_domain string, label string, seq int")
    out = {(r.sender_address, r.sender_domain): (r.label, r.mapping_id) for r in ST.upsert_sender_mapping(m, upd).collect()}
    assert out[("a@x", None)] == ("L3", 1) and out[(None, "x")] == ("L5", 2) and out[(None, "y")][0] == "L4"


def test_historical_features_per_mailbox(spark):
    rows = [("a", "s@x.com", T0, True, False), ("b", "s@x.com", T0 + dt.timedelta(hours=5), False, True),
            ("c", "t@y.org", T0 + dt.timedelta(days=1), True, False)]
    one = _mail(spark, rows)
    two = one.withColumn("mailbox", F.lit("m1")).unionByName(
        _mail(spark, rows + [("d", "s@x.com", T0 + dt.timedelta(days=2), True, False)]).withColumn("mailbox", F.lit("m2"))
    )
    single = {r.message_id: r for r in FE.historical_features(one).collect()}
    multi = {(r.mailbox, r.message_id): r for r in FE.historical_features(two, by=["mailbox"]).collect()}
    for mid, r in single.items():
        m = multi[("m1", mid)]
        assert (m.sender_email_count, m.sender_open_rate, m.sender_days_since_last, m.domain_open_rate) == (
            r.sender_email_count, r.sender_open_rate, r.sender_days_since_last, r.domain_open_rate)
    assert multi[("m2", "a")].sender_email_count == 3 and multi[("m1", "a")].sender_email_count == 2
    targ = two.filter(F.col("message_id") == "d")
    t = FE.historical_features(two, targets=targ, by=["mailbox"]).first()
    assert t.sender_days_since_last == pytest.approx(2 - 5 / 24)


def test_sequential_history_per_mailbox(spark):
    cols = "mailbox string, message_id string, from_address string, date timestamp_ntz, was_read boolean, was_archived boolean"
    committed = spark.createDataFrame(
        [("m1", "old1", "s@x.com", T0, True, False), ("m2", "old1", "s@x.com", T0, False, False),
         ("m2", "old2", "s@x.com", T0, True, False)], cols
    )
    incoming = spark.createDataFrame(
        [("m1", "new", "s@x.com", T0 + dt.timedelta(days=1), True, False),
         ("m2", "new", "s@x.com", T0 + dt.timedelta(days=1), True, False)], cols
    )
    h = {(r.mailbox, r.message_id): r for r in TR.sequential_history(committed, incoming, 3600, by=["mailbox"]).collect()}
    assert h[("m1", "new")].sender_email_count == 1 and h[("m1", "new")].sender_open_rate == 1.0
    assert h[("m2", "new")].sender_email_count == 2 and h[("m2", "new")].sender_open_rate == 0.5
    assert h[("m2", "new")].sender_days_since_last == pytest.approx(1.0)
