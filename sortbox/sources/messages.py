"""Raw provider messages: the JSON message resource of a mail API.

``raw_messages`` derives a raw message table from the bridged mail (so the
round trip raw -> ``normalize_messages`` must give the mail back), and
``normalize_messages`` is the source operator that turns raw JSON text into
typed mail rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

from ..functions import mime as M
from . import bridge as B
from .materialize import materialized

CORRUPT_BEFORE = "2024-01-21 00:00:00"


def _b64url(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", ""), "+/", "-_")


def _build_raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_id, json) per bridged mail.  Shapes exercised: quoted display
    names, RFC 2047 encoded names (id % 11 = 0), bare addresses, a missing
    Subject header, a duplicated subject header whose last value wins
    (id % 5 = 0), an empty text/plain part before the real one (id % 7 = 0),
    one extra multipart level (id % 3 = 0) and a zone offset that is
    dropped without conversion."""
    # Sorted here: a mail is smaller than its JSON, so less is spilled.
    em = B.emails(spark, sf_dir).sortWithinPartitions("date").withColumn("_doc", F.substring("message_id", 2, 1 << 30).cast("bigint"))
    doc = F.col("_doc")
    enc_name = F.concat(F.lit("=?utf-8?b?"), F.regexp_replace(F.base64(F.encode("from_name", "UTF-8")), r"[\r\n]", ""), F.lit("?="))
    from_value = (
        F.when(F.col("from_name").isNull(), F.col("from_address"))
        .when(doc % 11 == 0, F.concat(enc_name, F.lit(" <"), F.col("from_address"), F.lit(">")))
        .otherwise(F.concat(F.lit('"'), F.col("from_name"), F.lit('" <'), F.col("from_address"), F.lit(">")))
    )
    hdr = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    date_value = F.concat(F.date_format("date", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0100"))
    headers = F.array_compact(
        F.array(
            F.when(doc % 5 == 0, hdr("Subject", F.lit("Old subject"))),
            hdr("From", from_value),
            hdr("To", F.col("to_address")),
            F.when(F.col("subject").isNotNull(), hdr("subject", F.col("subject"))),
            hdr("Date", date_value),
        )
    )
    leaf = lambda m, d: F.struct(F.lit(m).alias("mimeType"), F.struct(d.alias("data")).alias("body"))
    leaves = F.array_compact(
        F.array(
            F.when(doc % 7 == 0, leaf("text/plain", F.lit(""))),
            F.when(F.col("body_plain").isNotNull(), leaf("text/plain", _b64url(F.col("body_plain")))),
            leaf("text/html", _b64url(F.concat(F.lit("<p>"), F.coalesce("snippet", F.lit("")), F.lit("</p>")))),
        )
    )
    # Both branches must share one type: give the flat parts an empty body
    # struct and the nested part a NULL body.
    flat = F.transform(
        leaves,
        lambda x: F.struct(
            x["mimeType"].alias("mimeType"), x["body"].alias("body"), F.lit(None).cast("array<struct<mimeType:string,body:struct<data:string>>>").alias("parts")
        ),
    )
    nested = F.array(
        F.struct(
            F.lit("multipart/mixed").alias("mimeType"),
            F.lit(None).cast("struct<data:string>").alias("body"),
            leaves.alias("parts"),
        )
    )
    parts = F.when(doc % 3 == 0, nested).otherwise(flat)
    payload = F.struct(headers.alias("headers"), F.lit("multipart/alternative").alias("mimeType"), parts.alias("parts"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    msg = F.struct(
        # A few old messages arrive without an id (they must be quarantined).
        F.when((doc % 991 != 0) | (F.col("date") >= ntz_lit(CORRUPT_BEFORE)), F.col("message_id")).alias("id"),
        F.timestamp_diff("MILLISECOND", epoch, F.col("date")).cast("string").alias("internalDate"),
        F.col("thread_id").alias("threadId"),
        F.col("labels").alias("labelIds"),
        F.col("snippet").alias("snippet"),
        payload.alias("payload"),
    )
    # Every thirteenth message is forwarded nine times over: its parts lie below
    # nine more multipart levels.
    text = F.to_json(msg)
    wrapped = F.regexp_replace(text, r'"parts":\[', '"parts":[' + '{"mimeType":"multipart/mixed","parts":[' * 9)
    closed = F.regexp_replace(wrapped, r'\]\}\}$', "]" + "}]" * 9 + "}}")
    deep = (doc % 13 == 0) & (doc % 3 != 0)
    return em.select(doc.alias("raw_id"), F.col("date").alias("received_at"), F.when(deep, closed).otherwise(text).alias("json"))


def normalize_messages(raw: DataFrame, ingest_ts: Column, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Raw JSON -> (mail rows, quarantined rows).

    Rows without an id or thread id (or unparseable JSON) go to the
    quarantine frame instead of failing the whole job.
    """
    # Typed parse: every field is read once; malformed JSON yields NULLs and
    # lands in the quarantine.
    parsed = raw.select("*", F.from_json(F.col(json_col), M.message_schema(), {"mode": "PERMISSIVE"}).alias("_m"))
    m = F.col("_m")
    base = M.with_mime_parts(parsed, m["payload"], "_parts").select(
        *raw.columns,
        m["id"].alias("_id"),
        m["threadId"].alias("_thread"),
        F.coalesce(m["snippet"], F.lit("")).alias("_snippet"),
        F.coalesce(m["labelIds"], F.array().cast("array<string>")).alias("_labels"),
        F.coalesce(m["payload"]["headers"], F.array().cast(M.HEADER_TYPE)).alias("_headers"),
        "_parts",
    )
    bad = base.filter(F.col("_id").isNull() | F.col("_thread").isNull()).select(*raw.columns)
    good = base.filter(F.col("_id").isNotNull() & F.col("_thread").isNotNull())
    h = F.col("_headers")
    good = good.select(
        "*",
        M.header_lookup(h, "from").alias("_from"),
        M.header_lookup(h, "to").alias("_to"),
        M.header_lookup(h, "subject").alias("_subject"),
        M.header_lookup(h, "date").alias("_date"),
        M.first_body_data(F.col("_parts"), "text/plain").alias("_plain_data"),
        M.first_body_data(F.col("_parts"), "text/html").alias("_html_data"),
    ).drop("_parts").select(
        "*",
        M.address_fast_path(F.col("_from")).alias("_fa"),
        M.address_fast_path(F.col("_to")).alias("_ta"),
    )
    # Rare header shapes take the Arrow slow path; every other row hands the
    # UDF a NULL (one pass over the data, no second scan of the input).
    slow_from = M.parse_address_slow(F.when(~F.col("_fa.ok"), F.col("_from")))
    slow_to = M.parse_address_slow(F.when(~F.col("_ta.ok"), F.col("_to")))
    g = good.select("*", slow_from.alias("_fs"), slow_to.alias("_ts")).select(
        "*",
        F.when(F.col("_fa.ok"), F.col("_fa.name")).otherwise(F.col("_fs.name")).alias("_fname"),
        F.when(F.col("_fa.ok"), F.col("_fa.address")).otherwise(F.col("_fs.address")).alias("_faddr"),
        F.when(F.col("_ta.ok"), F.col("_ta.address")).otherwise(F.col("_ts.address")).alias("_taddr"),
    )
    labels = F.col("_labels")
    out = g.select(
        F.col("_id").alias("message_id"),
        F.col("_thread").alias("thread_id"),
        F.col("_faddr").alias("from_address"),
        F.col("_fname").alias("from_name"),
        F.col("_taddr").alias("to_address"),
        F.coalesce(F.col("_subject"), F.lit("(No Subject)")).alias("subject"),
        M.parse_mail_date(F.col("_date"), ingest_ts).alias("date"),
        F.col("_snippet").alias("snippet"),
        M.body_text(F.col("_plain_data")).alias("body_plain"),
        M.body_text(F.col("_html_data")).alias("body_html"),
        labels.alias("labels"),
        (~F.array_contains(labels, "UNREAD")).alias("was_read"),
        (~F.array_contains(labels, "INBOX")).alias("was_archived"),
        F.array_contains(labels, "IMPORTANT").alias("is_important"),
        F.array_contains(labels, "STARRED").alias("is_starred"),
    )
    return out, bad


def select_messages(
    raw: DataFrame,
    label_ids: list[str] | None = None,
    after: dt.date | None = None,
    before: dt.date | None = None,
    max_total: int | None = None,
    json_col: str = "json",
) -> DataFrame:
    """The table form of listing messages: raw rows carrying every label in
    ``label_ids`` with ``after`` <= day < ``before`` (day granularity, on
    the message's internal date), newest first, capped at ``max_total``
    (a falsy cap means no cap)."""
    v = F.try_parse_json(F.col(json_col))
    if "received_at" in raw.columns:
        # Stored alongside the message: the date filter reaches the parquet
        # scan (row-group skipping) before any JSON is parsed.
        ts = F.col("received_at")
    else:
        ms = F.try_variant_get(v, "$.internalDate", "bigint")
        ts = F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    out = raw.withColumn("_ts", ts)
    if after:
        out = out.filter(F.col("_ts") >= ntz_lit(dt.datetime.combine(after, dt.time())))
    if before:
        out = out.filter(F.col("_ts") < ntz_lit(dt.datetime.combine(before, dt.time())))
    labs = F.coalesce(F.try_variant_get(v, "$.labelIds", "array<string>"), F.array().cast("array<string>"))
    for lab in label_ids or []:
        out = out.filter(F.array_contains(labs, lab))
    if max_total:
        # Only a capped listing needs the newest-first order.
        out = out.orderBy(F.col("_ts").desc(), F.col(raw.columns[0])).limit(max_total)
    return out.drop("_ts")


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw message table (stored form, written once per application,
    sorted by receive time so row groups carry tight min/max statistics)."""
    return materialized(
        spark, f"raw_messages|{sf_dir}", lambda: _build_raw_messages(spark, sf_dir)
    )
