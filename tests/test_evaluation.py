"""Evaluation operators: hand-computed cases and brute-force checks."""

import numpy as np
import pytest

from sortbox.operators import evaluation as EV


def _scored(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, score double")


def test_archive_precision(spark):
    df = _scored(spark, [0, 0, 0, 1, 1], [0.1, 0.2, 0.25, 0.28, 0.35])
    r = EV.archive_precision(df, [0.3]).first()
    assert r.n_archived == 4 and r.n_false_positives == 1
    assert r.archive_precision == pytest.approx(0.75)


def test_archive_precision_none_archived(spark):
    r = EV.archive_precision(_scored(spark, [0, 1], [0.5, 0.9]), [0.3]).first()
    assert (r.n_archived, r.archive_precision, r.false_positive_rate) == (0, 0.0, 0.0)


def test_evaluate_confusion(spark):
    r = EV.evaluate(_scored(spark, [0, 0, 1, 1], [0.2, 0.7, 0.3, 0.8]), 0.5).first()
    assert (r.true_negatives, r.false_positives, r.false_negatives, r.true_positives) == (1, 1, 1, 1)
    assert r.auc == pytest.approx(0.75)


def test_auc_single_class_is_null(spark):
    assert EV.auc(_scored(spark, [1, 1], [0.2, 0.4])).first().auc is None


def _brute_auc(y, p):
    pos = [b for a, b in zip(y, p) if a == 1]
    neg = [b for a, b in zip(y, p) if a == 0]
    s = sum((1.0 if x > z else 0.5 if x == z else 0.0) for x in pos for z in neg)
    return s / (len(pos) * len(neg))


def test_auc_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300), 1)  # many ties
    got = EV.auc(_scored(spark, y, p)).first().auc
    assert got == pytest.approx(_brute_auc(list(y), list(p)))


def test_sweep_equals_single_threshold(spark):
    rng = np.random.default_rng(5)
    df = _scored(spark, rng.integers(0, 2, 200), np.round(rng.random(200), 2))
    sweep = {r.threshold: r for r in EV.threshold_sweep(df, [0.1, 0.3, 0.5, 0.9]).collect()}
    for t in (0.1, 0.3, 0.5, 0.9):
        one = EV.threshold_metrics(df, t).first()
        assert (sweep[t].tp, sweep[t].fp, sweep[t].tn, sweep[t].fn) == (one.tp, one.fp, one.tn, one.fn)
        assert sweep[t].f1 == pytest.approx(one.f1)


def _brute_curve(y, p):
    ts = sorted(set(p), reverse=True)
    tps = [sum(1 for a, b in zip(y, p) if b >= t and a == 1) for t in ts]
    fps = [sum(1 for a, b in zip(y, p) if b >= t and a == 0) for t in ts]
    return ts, tps, fps


def test_roc_curve_drops_collinear_points(spark):
    rng = np.random.default_rng(7)
    y = list(rng.integers(0, 2, 120))
    p = list(np.round(rng.random(120), 1))
    ts, tps, fps = _brute_curve(y, p)
    keep = [0] + [i for i in range(1, len(ts) - 1) if (fps[i + 1] - 2 * fps[i] + fps[i - 1]) or (tps[i + 1] - 2 * tps[i] + tps[i - 1])] + [len(ts) - 1]
    P, N = sum(y), len(y) - sum(y)
    want = {(float("inf"), 0.0, 0.0)} | {(ts[i], round(fps[i] / N, 9), round(tps[i] / P, 9)) for i in keep}
    got = {(r.threshold, round(r.fpr, 9), round(r.tpr, 9)) for r in EV.roc_curve(_scored(spark, y, p)).collect()}
    assert got == want


def test_pr_curve(spark):
    y = [0, 1, 1, 0, 1]
    p = [0.1, 0.4, 0.35, 0.8, 0.8]
    ts, tps, fps = _brute_curve(y, p)
    want = {(t, tp / (tp + fp), tp / 3) for t, tp, fp in zip(ts, tps, fps)} | {(None, 1.0, 0.0)}
    got = {(r.threshold, r.precision, r.recall) for r in EV.pr_curve(_scored(spark, y, p)).collect()}
    assert {(a, round(b, 9), round(c, 9)) for a, b, c in got} == {(a, round(b, 9), round(c, 9)) for a, b, c in want}


def test_optimal_threshold_fallback(spark):
    df = _scored(spark, [0, 0, 1], [0.9, 0.95, 0.1])
    r = EV.optimal_threshold(df, "f1", min_precision=0.99).first()
    assert r.fallback and r.threshold == pytest.approx(0.9)


def test_classification_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    rows = {r.label: r for r in EV.classification_report(df).collect()}
    assert rows["a"].precision == 1.0 and rows["a"].recall == 0.5
    assert rows["b"].precision == pytest.approx(1 / 3) and rows["c"].f1 == 0.0
    assert rows["macro avg"].support == 4
