"""Ingest jobs, label dictionary, references, feature build, registry smoke."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as E
from sortbox.operators import store as ST
from sortbox.plans import build_features as BF
from sortbox.plans import ingest as IG
from sortbox.plans.q_features import built_features
from sortbox.sources import bridge as B
from sortbox.sources import messages as MS

SF = "/root/testdata/sf0.001"


def test_ingest_history_quarantines_bad_rows(spark):
    raw = MS.raw_messages(spark, SF)
    existing = B.emails(spark, SF).filter(F.col("date") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    r = IG.ingest_history(raw, existing, dt.datetime(2024, 2, 1), months=2)
    s = r["summary"].first()
    assert s.selected == raw.count() and s.failed == r["quarantine"].count() and s.saved + s.failed == s.selected
    table = r["table"]
    assert table.select("message_id").distinct().count() == table.count()


def test_label_dictionary_continues_ids(spark):
    existing = spark.createDataFrame([("INBOX", 1), ("UNREAD", 2)], "name string, label_id bigint")
    em = spark.createDataFrame([("a", ["INBOX", "Zeta", "Alpha"]), ("b", ["Alpha"])], "message_id string, labels array<string>")
    got = {r.name: r.label_id for r in ST.label_dictionary(existing, em).collect()}
    assert got == {"INBOX": 1, "UNREAD": 2, "Alpha": 3, "Zeta": 4}


def test_check_references_and_cascade(spark):
    em = spark.createDataFrame([("a",)], "message_id string")
    kids = {"email_actions": spark.createDataFrame([("a",), ("b",), ("b",)], "message_id string")}
    r = ST.check_references(em, kids).first()
    assert (r.table, r.orphans) == ("email_actions", 2)
    left = ST.cascade_delete(kids, spark.createDataFrame([("a",)], "message_id string"))["email_actions"]
    assert left.count() == 2


def test_build_features_fills_backlog(spark):
    em = B.emails(spark, SF)
    store = built_features(spark, SF)
    r = BF.build_features(em, store, dt.datetime(2024, 2, 1))
    table = r["table"]
    assert table.count() == em.count()
    assert r["new"].count() == em.count() - store.count()


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    for k, sql in o.items():
        assert sql.strip().upper().startswith(("SELECT", "WITH")), k


def test_ingest_recent_fails_on_bad_rows(spark):
    import pytest

    raw = MS.raw_messages(spark, SF)
    existing = B.emails(spark, SF).limit(0)
    assert MS.normalize_messages(raw, F.lit(None).cast("timestamp_ntz"))[1].count() > 0
    # the window covers the old id-less rows -> the whole job fails
    r = IG.ingest_recent(raw, existing, dt.datetime(2024, 2, 1), days=60)
    with pytest.raises(Exception):
        r["table"].count()
    with pytest.raises(Exception):
        r["summary"].collect()
    # a clean window succeeds
    ok = IG.ingest_recent(raw, existing, dt.datetime(2024, 2, 1), days=7)["summary"].first()
    assert ok.failed == 0 and ok.saved == ok.selected


def test_label_ids_of_many_names_with_one_beginning(spark):
    """Ids follow the names, and the names of one beginning are dealt to many ranges."""
    from pyspark.sql import functions as F

    from sortbox.operators import store as ST

    n = 20_000
    names = spark.range(n).select(F.array(F.format_string("Bot/%06d", (F.col("id") * 7919) % n), F.lit("Bot/000003")).alias("labels"))
    existing = spark.createDataFrame([("Bot/000003", 5), ("Old", 9)], "name string, label_id long")
    got = {r.name: r.label_id for r in ST.label_dictionary(existing, names).collect()}
    fresh = sorted(f"Bot/{i:06d}" for i in range(n) if i != 3)
    assert got == {"Bot/000003": 5, "Old": 9} | {x: 10 + i for i, x in enumerate(fresh)}
    assert {r.name: r.label_id for r in ST.label_dictionary(existing, names.limit(0)).collect()} == {"Bot/000003": 5, "Old": 9}
    boxes = names.limit(50).select(F.lit("a").alias("box"), "labels").union(names.limit(50).select(F.lit("b").alias("box"), "labels"))
    of_box = ST.label_dictionary(spark.createDataFrame([("a", "Old", 3)], "box string, name string, label_id long"), boxes, by=["box"]).collect()
    for box, first in (("a", 4), ("b", 1)):
        ids = [r.label_id for r in sorted(of_box, key=lambda r: r.name) if r.box == box and r.name != "Old"]
        assert ids == list(range(first, first + len(ids))) and len(ids) >= 50
