"""Label centroids and nearest-centroid matching."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sortbox.operators import labels as LB

T0 = dt.datetime(2024, 1, 1)


def test_nearest_label_threshold_and_ties(spark):
    cents = spark.createDataFrame(
        [("Bot/B", [1.0, 0.0]), ("Bot/A", [2.0, 0.0]), ("Bot/Z", [0.0, 0.0])], "label string, centroid array<double>"
    )
    feats = spark.createDataFrame(
        [("x", [3.0, 0.0]), ("y", [0.0, 1.0]), ("z", [0.0, 0.0]), ("w", None), ("v", [1.0, 1.0])],
        "message_id string, subject_embedding array<double>",
    )
    got = {r.message_id: (r.nearest_label, r.similarity) for r in LB.nearest_label(feats, cents).collect()}
    assert got["x"][0] == "Bot/A" and got["x"][1] == pytest.approx(1.0)  # tie: first label in order
    assert got["y"] == (None, None)  # orthogonal, below threshold
    assert got["z"] == (None, None) and got["w"] == (None, None)  # zero norm / missing
    assert got["v"] == (None, None)  # cos = 0.707 is not > 0.75
    for blocks in (2, 5):
        again = {r.message_id: (r.nearest_label, r.similarity) for r in LB.nearest_label(feats, cents, blocks=blocks).collect()}
        assert again == got


def test_label_centroids_sample_cap_before_dropping_empty(spark):
    rows = [(f"m{i}", "s@x.com", T0 + dt.timedelta(hours=i)) for i in range(12)]
    emails = spark.createDataFrame(rows, "message_id string, from_address string, date timestamp_ntz")
    # the newest mail has no embedding: it still takes one of the 10 slots
    feats = spark.createDataFrame(
        [(f"m{i}", None if i == 11 else [float(i), 1.0]) for i in range(12)], "message_id string, subject_embedding array<double>"
    )
    maps = spark.createDataFrame([(1, "s@x.com", None, "Bot/S")], "mapping_id long, sender_address string, sender_domain string, label string")
    c = LB.label_centroids(emails, feats, maps, per_sender=10).first()
    # newest ten are m11..m2; m11 has no embedding -> mean over m10..m2
    assert c.n == 9 and c.centroid == pytest.approx([sum(range(2, 11)) / 9, 1.0])
    everything = LB.label_centroids(emails, feats, maps).first()
    assert everything.n == 11 and everything.centroid == pytest.approx([sum(range(11)) / 11, 1.0])
    assert LB.sender_sample(emails, feats, maps).filter(F.col("rank") <= 10).count() == 10


def brute_nearest(mail, labels, threshold):
    """The packed rule on arrays, pair by pair."""
    import numpy as np

    out = {}
    for key, v in mail.items():
        best = (None, None)
        for label, c in sorted(labels.items()):
            if not v or not c or len(v) != len(c) or not any(c) or not any(v):
                continue
            a, b = np.array(v), np.array(c)
            sim = float(np.cumsum(a * b)[-1] / (np.sqrt(np.cumsum(a * a)[-1]) * np.sqrt(np.cumsum(b * b)[-1])))
            if sim > threshold and (best[1] is None or sim > best[1]):
                best = (label, sim)
        out[key] = best
    return out


@pytest.mark.parametrize("threshold", [0.75, 0.2, -2.0])
def test_inverted_lists_against_brute_force(spark, monkeypatch, threshold):
    import numpy as np

    from sortbox.operators import nearest as NE

    for name, small in (("PART", 16), ("MAIL", 40), ("PIVOTS", 12)):
        monkeypatch.setattr(NE, name, small)
    r = np.random.default_rng(5)
    centres = r.normal(size=(9, 6))
    make = lambda: [float(x) for x in np.round(centres[r.integers(9)] + 0.4 * r.normal(size=6), 3)]
    labels = {f"L{i}": make() for i in range(300)}
    labels |= {"L0copy": labels["L0"], "A-copy": labels["L0"], "Z": [0.0] * 6, "none": None, "empty": [], "short": [1.0, 2.0], "short2": [2.0, 4.0]}
    mail = {f"m{i}": make() for i in range(250)} | {"same": labels["L0"], "zero": [0.0] * 6, "null": None, "empty": [], "pair": [1.0, 2.0], "alone": [1.0]}
    df = spark.createDataFrame(list(mail.items()), "message_id string, subject_embedding array<double>").withColumn("label", F.lit("clash"))
    cents = spark.createDataFrame(list(labels.items()), "label string, centroid array<double>")
    got = {x.message_id: (x.nearest_label, x.similarity) for x in LB.nearest_label(df, cents, threshold=threshold, packed_labels=10).collect()}
    want = brute_nearest(mail, labels, threshold)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[1], abs=1e-12) for k, v in want.items() if v[0])
    assert got["same"][0] == "A-copy" and got["alone"] == (None, None)


def test_labels_of_each_mailbox(spark):
    import numpy as np

    r = np.random.default_rng(6)
    make = lambda: [float(x) for x in np.round(r.normal(size=3), 2)]
    labels = {(box, f"L{i}"): make() for box in ("a", "b", "c") for i in range(40)}
    mail = {(box, f"m{i}"): make() for box in ("a", "b", "d") for i in range(60)}
    df = spark.createDataFrame([(*k, v) for k, v in mail.items()], "box string, message_id string, subject_embedding array<double>")
    cents = spark.createDataFrame([(*k, v) for k, v in labels.items()], "box string, label string, centroid array<double>")
    got = {(x.box, x.message_id): x.nearest_label for x in LB.nearest_label(df, cents, by=["box"]).collect()}
    for box in ("a", "b", "d"):
        want = brute_nearest({k[1]: v for k, v in mail.items() if k[0] == box}, {k[1]: v for k, v in labels.items() if k[0] == box}, LB.SIMILARITY_THRESHOLD)
        assert {m: got[box, m] for m in want} == {m: v[0] for m, v in want.items()}
    assert LB.nearest_label(df.limit(0), cents, by=["box"]).count() == 0
    assert LB.nearest_label(df, cents.limit(0), by=["box"]).where("nearest_label is not null").count() == 0


def test_a_hundred_thousand_labels(spark):
    """No limit on labels: every mail finds its own copy among 100,000 of them."""
    n = 100_000
    wave = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k * 0.7309 + k))
    cents = spark.range(n).select(F.format_string("L%06d", "id").alias("label"), wave.alias("centroid"))
    mail = spark.range(0, n, 97).select(F.concat(F.lit("m"), "id").alias("message_id"), F.format_string("L%06d", "id").alias("own"), wave.alias("subject_embedding"))
    got = LB.nearest_label(mail, cents).join(mail, "message_id")
    assert got.where("similarity < 1 - 1e-9 or nearest_label is null").count() == 0
    assert got.where("nearest_label = own").count() > 0.99 * mail.count()
