"""Scalar column functions: hand-computed cases."""

import datetime as dt

from pyspark.sql import functions as F

from sortbox.functions import columns as C


def _one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_sender_domain(spark):
    assert _one(spark, C.sender_domain("x"), "test@sub.example.com") == "sub.example.com"
    assert _one(spark, C.sender_domain("x"), "User@Mail.Example.COM") == "mail.example.com"
    assert _one(spark, C.sender_domain("x"), "invalid") == "unknown"
    assert _one(spark, C.sender_domain("x"), "") == "unknown"
    assert _one(spark, C.sender_domain("x"), None) == "unknown"
    assert _one(spark, C.sender_domain("x"), "a@b@c.org") == "c.org"


def test_raw_domains_first_and_last(spark):
    assert _one(spark, C.raw_domain_last("x"), "a@b@C.org") == "C.org"
    assert _one(spark, C.raw_domain_first("x"), "a@b@c.org") == "b"
    assert _one(spark, C.raw_domain_first("x"), "nodomain") is None


def test_sender_hash(spark):
    import hashlib

    assert _one(spark, C.sender_hash("x"), "User@Example.com") == hashlib.sha256(b"user@example.com").hexdigest()[:16]
    assert _one(spark, C.sender_hash("x"), "") == ""


def test_time_features(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15, 14, 30),)], "d timestamp_ntz")
    r = df.select(C.day_of_week("d").alias("w"), C.hour_of_day("d").alias("h")).first()
    assert (r.w, r.h) == (0, 14)


def test_newsletter(spark):
    df = spark.createDataFrame(
        [(["INBOX"], "Weekly Newsletter", None), (["listid"], "hi", "x"), ([], "mailing\nlist", "x"), ([], "opt-out here", "")],
        "labels array<string>, subject string, body string",
    )
    got = [r.n for r in df.select(C.is_newsletter("labels", "subject", "body").alias("n")).collect()]
    # '.' does not match a newline
    assert got == [True, True, False, True]


def test_clean_label_name(spark):
    assert _one(spark, C.clean_label_name("x"), "A  B  C") == "A-B-C"
    assert _one(spark, C.clean_label_name("x"), "hello@world") == "Helloworld"
    assert _one(spark, C.clean_label_name("x"), "café crème") == "Café-Crème"
    long = "alpha beta gamma delta epsilon zeta"
    # cut to 30 characters, then the partial last word dropped
    assert _one(spark, C.clean_label_name("x"), long) == "Alpha-Beta-Gamma-Delta"


def test_domain_to_label(spark):
    assert _one(spark, C.domain_to_label("x"), "newsletters.example.org") == "Example"
    assert _one(spark, C.domain_to_label("x"), "ab.io") is None
    assert _one(spark, C.domain_to_label("x"), "email.shop.com") == "Eshop"
    assert _one(spark, C.domain_to_label("x"), "www.techsite.com") == "Techsite"


def test_normalize_semantic_label(spark):
    assert _one(spark, C.normalize_semantic_label("x"), ' "machine_learning" ') == "Machine-Learning"
    assert _one(spark, C.normalize_semantic_label("x"), "tech-NEWS") == "Tech-News"


def test_review_snippet(spark):
    assert _one(spark, C.review_snippet("x"), "a &amp;lt; b &gt; c") == "a &lt; b > c"
    assert _one(spark, C.review_snippet("x"), "") == "N/A"
    assert _one(spark, C.review_snippet("x"), None) == "N/A"


def test_prepare_text_and_body_source(spark):
    assert _one(spark, C.prepare_text(F.col("x")), "  a \n\t b  ") == "a b"
    df = spark.createDataFrame([("", "snip"), (None, None), ("body", "snip")], "b string, s string")
    assert [r.r for r in df.select(C.body_source("b", "s").alias("r")).collect()] == ["snip", "", "body"]


def test_user_and_bot_labels(spark):
    df = spark.createDataFrame([(["INBOX", "Work", "Bot/Receipts", "SPAM", "Travel"],)], "labels array<string>")
    r = df.select(C.user_labels("labels").alias("u"), C.bot_labels("labels").alias("b")).first()
    assert r.u == ["Work", "Travel"] and r.b == ["Bot/Receipts"]
