"""Labels in blocks, states of many mails at once."""

import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sortbox.operators import labels as LB
from sortbox.operators import nearest as NE
from sortbox.operators import store as ST
from sortbox.plans.q_stream import stage_files
from sortbox.session import scratch_path
from sortbox.streaming import bounded as SB
from sortbox.streaming import jobs as SJ


def brute(mail, labels, threshold):
    out = {}
    for key, v in mail.items():
        a = np.array(v)
        sims = [(float(np.cumsum(a * b)[-1] / (np.sqrt(np.cumsum(a * a)[-1]) * np.sqrt(np.cumsum(b * b)[-1]))), n) for n, b in ((n, np.array(c)) for n, c in labels.items())]
        top = max(s for s, _ in sims)
        out[key] = (min((n for s, n in sims if s == top), key=str.encode), top) if top > threshold else (None, None)
    return out


def shuffled_records(node):
    """Records written by the exchanges of an executed plan."""
    if "QueryStage" in node.nodeName():
        return shuffled_records(node.plan())
    if node.nodeName() == "AdaptiveSparkPlan":
        return shuffled_records(node.executedPlan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
    return own + sum(shuffled_records(node.children().apply(i)) for i in range(node.children().size()))


@pytest.mark.parametrize("threshold", [0.3, -2.0])
def test_a_mail_goes_to_a_block_once(spark, monkeypatch, threshold):
    r = np.random.default_rng(3)
    make = lambda n, name: {f"{name}{i}": [float(x) for x in r.normal(size=12).astype(np.float32)] for i in range(n)}
    labels, mail = make(1000, "L"), make(400, "m")
    labels |= {"A": labels["L7"], "é": labels["L8"], "L8b": labels["L8"]}
    mail |= {"seven": labels["L7"], "eight": labels["L8"]}
    df = spark.createDataFrame(list(mail.items()), "message_id string, subject_embedding array<double>")
    cents = spark.createDataFrame(list(labels.items()), "label string, centroid array<double>")
    want = brute(mail, labels, threshold)
    assert want["seven"][0] == "A" and want["eight"][0] == "L8"

    def check(got):
        assert {x.message_id: x.nearest_label for x in got.collect()} == {k: v[0] for k, v in want.items()}
        assert all(x.similarity is None if want[x.message_id][0] is None else x.similarity == pytest.approx(want[x.message_id][1], abs=1e-12) for x in got.collect())

    # Vectors in all directions: no list of the 30 or so is ruled out, and yet a mail is copied a few times only.
    got = LB.nearest_label(df, cents, threshold=threshold, packed_labels=0)
    check(got)
    assert shuffled_records(got._jdf.queryExecution().executedPlan()) < 8 * (len(mail) + len(labels))
    for name, small in (("PART", 100), ("HELD", 60), ("MAIL", 50)):
        monkeypatch.setattr(NE, name, small)
    check(LB.nearest_label(df, cents, threshold=threshold, packed_labels=0))
    monkeypatch.setattr(NE, "VALUES", 12 * 30)
    monkeypatch.setattr(NE, "PIVOTS", 3)  # lists larger than a block
    check(LB.nearest_label(df, cents, threshold=threshold, packed_labels=0))


def test_a_piece_of_a_block_in_small_products(monkeypatch):
    for name, small in (("AT_ONCE", 7), ("ACROSS", 5), ("PAIRS", 4)):
        monkeypatch.setattr(NE, name, small)
    r = np.random.default_rng(4)
    vectors = np.round(r.normal(size=(60, 5)), 1)
    labels = {f"L{i}": list(vectors[i]) for i in range(60)} | {f"K{i}": list(vectors[i]) for i in range(0, 60, 2)}
    ranks = {n: int(n[1:]) % 4 for n in labels}
    mail, lists = {f"m{i}": list(np.round(r.normal(size=5), 1)) for i in range(40)}, {f"m{i}": sorted({i % 4, i % 3, 9}) for i in range(40)}
    kind = pa.list_(pa.float64())
    m = pa.table({"message_id": list(mail), "v": pa.array(mail.values(), kind), "lists": pa.array(lists.values(), pa.list_(pa.int32()))})
    c = pa.table({"label": list(labels), "v": pa.array(labels.values(), kind), "rank": pa.array(ranks.values(), pa.int32())})
    got = {x["message_id"]: (x["label"], x["similarity"]) for x in NE.best_of(m, c, -2.0).to_pylist()}
    for key, v in mail.items():
        own = {n: x for n, x in labels.items() if ranks[n] in lists[key]}
        assert got[key] == brute({key: v}, own, -2.0)[key]
    above = {x["message_id"]: x["label"] for x in NE.best_of(m, c, 0.9).to_pylist() if x["similarity"] > 0.9}
    assert above == {k: n for k, (n, s) in got.items() if s > 0.9}
    assert NE.best_of(m, c.slice(0, 0), 0.5).num_rows == 0 and NE.best_of(m.slice(0, 0), c, 0.5).num_rows == 0


def test_mails_of_a_bucket_share_a_state_and_expire_one_by_one():
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

    def put(ms, *rows):
        h.calls.clear()
        return {tuple(r) for r in p.handleInputRows((3,), iter([Row(message_id=m, label=n, kind=k, at=a, id=i) for m, n, k, a, i in rows]), Now(ms))}

    first = [("a", "A", "add", 5, 1), ("b", "A", "add", 5, 1), ("b", None, "add", -1, -1), (None, "A", "add", 2, 2)]
    assert put(0, *first) == set(first) and h.calls == ["get", "timer 100", "update"]
    assert put(60, ("b", "A", "remove", 4, 9), ("b", "B", "add", 1, 1), ("a", "A", "add", 5, 1)) == {("b", "B", "add", 1, 1)} and h.calls == ["get", "update"]
    put(70, ("b", "B", "remove", 0, 0))
    h.calls.clear()
    assert list(p.handleExpiredTimer((3,), Now(100), None)) == [] and h.calls == ["get", "timer 160", "update"]  # the mail without an id goes
    assert put(120, (None, "A", "add", 1, 1), ("a", "A", "add", 4, 4)) == {(None, "A", "add", 1, 1)}
    h.calls.clear()
    list(p.handleExpiredTimer((3,), Now(170), None))
    assert h.calls == ["get", "timer 220", "update"]  # b goes at 170, a and the mail without an id at 220
    assert put(180, ("b", "A", "remove", 1, 1), ("a", "A", "add", 3, 3)) == {("b", "A", "remove", 1, 1)}
    list(p.handleExpiredTimer((3,), Now(500), None))
    assert h.value is None


def test_many_mails_in_few_states_equal_the_batch_fold(spark):
    r = np.random.default_rng(8)
    kinds, base = ["archive", "mark_read", "mark_unread", "move_to_inbox", "add_labels", "remove_labels"], scratch_path(spark, f"round-four-{uuid.uuid4().hex}")
    ops = [(f"m{r.integers(60)}", (int(r.integers(40)), i), kinds[r.integers(6)], [f"X{r.integers(3)}"], int(r.integers(100))) for i in range(500)]
    sent = spark.createDataFrame(ops, "message_id string, seq struct<at: bigint, id: bigint>, op string, labels array<string>, arrived bigint")
    em = sent.select("message_id", F.array().cast("array<string>").alias("labels")).distinct()
    stage_files(sent, f"{base}/ops", "arrived", 4)
    stream = SJ.file_stream(SB.stateful_session(spark), f"{base}/ops", sent.schema, 1)
    got = ST.labels_of_states(SB.mailbox_states(stream, f"{base}/out", f"{base}/ckpt", 10**9, buckets=5))
    assert sorted(map(str, got.collect())) == sorted(map(str, ST.apply_label_ops(em, sent).collect()))
    assert SB.stateful_session(spark).read.format("statestore").option("stateVarName", "labels").load(f"{base}/ckpt").count() == 5
