"""Leaf-wise boosting against a plain version that splits one leaf at a time."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortbox.operators import boosting as BO
from sortbox.operators import evaluation as EV


def table(spark, n=900, seed=1, features=5):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, features)), 2)
    x[:, 1] = r.integers(0, 4, n)
    logit = 1.5 * (x[:, 0] > 0.3) + 0.8 * x[:, 2] * (x[:, 1] > 1) - 0.6
    y = (r.random(n) < 1 / (1 + np.exp(-2 * logit))).astype(int)
    test = r.random(n) < 0.25
    rows = [(f"m{i}", [float(v) for v in x[i]], int(y[i]), bool(test[i]), "extra") for i in range(n)]
    return spark.createDataFrame(rows, "message_id string, x array<double>, y int, is_test boolean, score string"), x, y, test


def plain(x, y, test, bounds, used_rows, s):
    """The same trees, one split after the other, on arrays."""
    bins = BO.binned(x, bounds)
    base = np.log(y[~test].mean() / (1 - y[~test].mean()))
    margin, trees, aucs = np.full(len(y), base), [], []

    def leaf_split(rows, g, h, features):
        best = (0.0, 0, 0)
        for f in features:
            for at in range(s.max_bin):
                left = rows[bins[rows, f] <= at]
                right = rows[bins[rows, f] > at]
                if min(len(left), len(right)) < s.min_rows or min(h[left].sum(), h[right].sum()) < s.min_curvature * BO.SCALE:
                    continue
                gl, hl, gr, hr = (float(v) for v in (g[left].sum(), h[left].sum(), g[right].sum(), h[right].sum()))
                gain = (gl * gl / hl + gr * gr / hr - (gl + gr) ** 2 / (hl + hr)) / BO.SCALE
                if gain > best[0] * (1 + 1e-12):
                    best = (gain, f, at)
        return best

    for t in range(s.rounds):
        g, h = BO.gradients(margin, y)
        features = BO.drawn_features(x.shape[1], t, s)
        rows = np.flatnonzero(~test & used_rows(t // s.row_every))
        leaves = [(rows, np.arange(len(y)), leaf_split(rows, g, h, features))]
        while len(leaves) < s.leaves and max(v[2][0] for v in leaves) > 0:
            i = max(range(len(leaves)), key=lambda i: leaves[i][2][0])
            rows, every, (_, f, at) = leaves.pop(i)
            for side in (True, False):
                part = rows[(bins[rows, f] <= at) == side]
                leaves.append((part, every[(bins[every, f] <= at) == side], leaf_split(part, g, h, features)))
        if len(leaves) == 1:
            break
        for rows, every, _ in leaves:
            margin[every] += -s.rate * g[rows].sum() / h[rows].sum()
        p, n = margin[test & (y == 1)], margin[test & (y == 0)]
        aucs.append(float(((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))))
        trees.append(margin.copy())
        if t - int(np.argmax(aucs)) >= s.patience:
            break
    return trees[int(np.argmax(aucs))], aucs


@pytest.mark.parametrize("leaves,share", [(5, 1.0), (9, 0.7)])
def test_equal_to_a_plain_version(spark, leaves, share):
    df, x, y, test = table(spark)
    s = BO.Settings(leaves=leaves, rate=0.3, rounds=12, patience=3, max_bin=16, row_share=share, row_every=2, min_rows=15)
    model = BO.fit(df.repartition(3), [f"f{i}" for i in range(5)], s)
    draws = {k: [r[0] for r in df.select("message_id", "x").withColumn("key", F.xxhash64("message_id")).select(BO.row_draw("key", s.seed, k)).collect()] for k in range(7)}
    used = lambda k: np.array(draws[k]) < int(share * BO.DRAWS) if share < 1 else np.ones(len(y), bool)
    margins, aucs = plain(x, y, test, model.bounds, used, s)
    assert np.allclose(model.aucs, aucs, atol=1e-12)
    assert np.allclose(model.margins(x), margins, atol=1e-9)
    assert len(model.trees) == int(np.argmax(aucs)) + 1 and max(len(t.feature) for t in model.trees) <= 2 * leaves - 1


def test_same_trees_for_any_partitions_and_small_passes(spark, monkeypatch):
    df, *_ = table(spark, 600, 2)
    s = BO.Settings(leaves=12, rounds=3, max_bin=20, min_rows=10)
    names = list("abcde")
    one = BO.fit(df.coalesce(1), names, s)
    monkeypatch.setattr(BO, "MAX_HISTOGRAM_BYTES", 1)  # two nodes a pass
    assert BO.fit(df.repartition(7, "x"), names, s).to_json() == one.to_json()


def test_rows_at_hand_give_the_trees_of_passes_in_few_jobs(spark, monkeypatch):
    df, *_ = table(spark, 400, 7)
    twice = df.unionByName(df.withColumn("message_id", F.concat("message_id", F.lit("again"))))  # equal rows
    s = BO.Settings(leaves=15, rounds=12, max_bin=20, min_rows=3, row_every=5, patience=30)
    sc = spark.sparkContext
    sc.setJobGroup("at hand", "")
    one = BO.fit(twice, list("abcde"), s)
    jobs = len(sc.statusTracker().getJobIdsForGroup("at hand"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(one.aucs) == s.rounds and 0 < jobs < 3 * s.rounds
    monkeypatch.setattr(BO, "AT_HAND", 0)
    monkeypatch.setattr(BO, "BLOCK", 6)
    assert BO.fit(twice, list("abcde"), s).to_json() == one.to_json()


def test_beats_chance_and_scores_rows(spark):
    df, x, y, test = table(spark, 1200, 3)
    model = BO.fit(df, list("abcde"), BO.Settings(rounds=6, rate=0.3, leaves=15))
    scored = BO.score(model, df.drop("score"))
    got = {r.message_id: r.score for r in scored.collect()}
    want = BO.sigmoid(model.margins(x))
    assert all(abs(got[f"m{i}"] - want[i]) < 1e-12 for i in range(len(y)))
    auc = EV.evaluate(scored.filter("is_test"), 0.5).first()["auc"]
    assert auc > 0.75 and abs(auc - max(model.aucs)) < 1e-9
    shares = model.importance()
    assert abs(sum(shares.values()) - 1) < 1e-9 and max(shares, key=shares.get) in ("a", "c")
    assert BO.Model.from_json(model.to_json()) == model and json.loads(model.to_json())["names"] == list("abcde")
    assert BO.score(model, df.drop("score").withColumn("x", F.lit(None).cast("array<double>"))).first().score is None


def test_auc_not_below_mllib(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df, *_ = table(spark, 1200, 4)
    model = BO.fit(df, list("abcde"), BO.Settings(rounds=8, rate=0.3, leaves=15))
    vec = df.select("message_id", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"), "y", "is_test")
    gbt = GBTClassifier(maxIter=8, stepSize=0.3, maxDepth=5, subsamplingRate=0.8, validationIndicatorCol="is_test", seed=42)
    other = gbt.fit(vec).transform(vec.filter("is_test")).select("y", vector_to_array("probability")[1].alias("score"))
    assert max(model.aucs) >= EV.evaluate(other, 0.5).first()["auc"] - 0.01


def test_one_class_and_no_rows(spark):
    df, *_ = table(spark, 60, 5)
    for rows in (df.withColumn("y", F.lit(1)), df.limit(0), df.filter("is_test")):
        model = BO.fit(rows, list("abcde"), BO.Settings(rounds=5))
        assert model.trees == [] and model.aucs == []
        assert BO.score(model, df.drop("score")).filter("score is null").count() == 0


def test_patience():
    assert BO.stopped([0.5, 0.7, 0.6, 0.7, 0.9, 0.1], 2) == [0.5, 0.7, 0.6, 0.7]
    assert BO.stopped([0.5, 0.7, 0.6], 2) == [0.5, 0.7, 0.6] and BO.stopped([], 2) == []
