"""Triage history from running totals equals the history aggregated from all mail."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sortbox.plans import history_totals as HT
from sortbox.plans import triage as TR

SCHEMA = "box string, message_id string, from_address string, date timestamp_ntz, was_read boolean"
SENDERS = ["hot@x.io", "HOT@X.io", "a@x.io", "b@y.org", "no-at", None, "a@b@y.org"]


def mails(r, ids):
    """A mail's sender and date follow from its id; whether it was read does not."""
    out = []
    for i in ids:
        k = random.Random(i)
        out.append((k.choice("pq"), f"m{i}", k.choice(SENDERS), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k.randrange(3000)), r.random() < 0.5))
    return out


@pytest.mark.parametrize("by", [None, ["box"]])
def test_history_by_deltas_equals_history_of_all_mail(spark, by):
    r = random.Random(7)
    stored = {m[1]: m for m in mails(r, range(80))}
    log = HT.totals(spark.createDataFrame(list(stored.values()), SCHEMA), 7200, by)
    for batch in (range(70, 95), range(90, 110), range(0)):
        old = spark.createDataFrame(list(stored.values()), SCHEMA)
        rows = mails(r, batch)
        new = spark.createDataFrame(rows, SCHEMA)
        totals = spark.createDataFrame(HT.fold(log).collect(), HT.SCHEMA)
        want = TR.sequential_history(old, new, 7200, by).collect()
        got = TR.sequential_history(old, new, 7200, by, totals=totals).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == len(rows)
        log = totals.unionByName(HT.deltas(old.join(new.select("message_id"), "message_id", "left_semi"), new, 7200, by))
        stored |= {m[1]: m for m in rows}
    full = HT.totals(spark.createDataFrame(list(stored.values()), SCHEMA), 7200, by)
    counts = lambda t: sorted(map(tuple, t.where("kind <> 'last' and n <> 0").select(F.coalesce("key", F.lit("-")), "kind", "n", "r").collect()))
    last = lambda t: sorted(map(tuple, t.where("kind = 'last' and key is not null").select("key", "bucket", "t").collect()))
    assert counts(HT.fold(log)) == counts(full) and last(HT.fold(log)) == last(full)
