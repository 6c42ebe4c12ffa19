"""Model evaluation operators over a scored DataFrame (``y`` in {0,1},
``score`` double).

Scale design
------------
* Threshold metrics are conditional aggregates (one pass, partial aggs).
* A threshold sweep buckets every row by the number of thresholds <= its
  score, aggregates per bucket (<= #thresholds + 1 rows) and then runs a
  cumulative sum over that tiny table: one pass for all thresholds.
* AUC, ROC and PR need running totals over the distinct scores in order.
  Distinct scores may be as many as rows, so a single global window would
  put everything in one task.  ``running_totals`` splits the score range
  into quantile buckets (``percentile_approx`` as a scalar subquery, no
  driver round trip), computes per-bucket totals, carries offsets across
  the (few) buckets with a broadcast of a table of bounded size, and runs
  the window inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SWEEP = [i / 10 for i in range(1, 10)]
FINE_SWEEP = [i / 100 for i in range(1, 100)]
ARCHIVE_THRESHOLDS = [0.2, 0.25, 0.3, 0.35]
MIN_RANGE_BUCKETS, MAX_RANGE_BUCKETS = 64, 1024


def _nan_low(c: Column) -> Column:
    """A NaN score is no positive prediction at any threshold (Spark orders
    NaN above every number)."""
    return F.when(F.isnan(c), F.lit(float("-inf"))).otherwise(c)


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0.0 when b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def confusion_counts(scored: DataFrame, threshold: float, y: str = "y", score: str = "score") -> DataFrame:
    pred = _nan_low(F.col(score)) >= F.lit(threshold)
    pos = F.col(y) == 1
    return scored.agg(
        F.count_if(pred & pos).alias("tp"),
        F.count_if(pred & ~pos).alias("fp"),
        F.count_if(~pred & ~pos).alias("tn"),
        F.count_if(~pred & pos).alias("fn"),
    )


def _rates(df: DataFrame) -> DataFrame:
    p = _div0(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    r = _div0(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def threshold_metrics(scored: DataFrame, threshold: float, y: str = "y", score: str = "score") -> DataFrame:
    """tp/fp/tn/fn, precision, recall, f1 at ``threshold`` (pred = score >= t)."""
    out = _rates(confusion_counts(scored, threshold, y, score))
    return out.select(F.lit(threshold).alias("threshold"), "precision", "recall", "f1", "tp", "fp", "tn", "fn")


def running_totals(
    df: DataFrame, order_col: str, value_cols: list[str], descending: bool = False, buckets: int | None = None
) -> DataFrame:
    """Adds ``cum_<v>`` = sum of ``v`` over all rows up to and including
    this one in ``order_col`` order (``order_col`` must be unique), plus
    ``_pid`` (the range bucket)."""
    if buckets is None:  # as many ranges as shuffle tasks, within bounds
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(max(tasks, MIN_RANGE_BUCKETS), MAX_RANGE_BUCKETS)
    qs = [i / buckets for i in range(1, buckets)]
    bounds = df.select(F.percentile_approx(order_col, qs, 10000).alias("b")).scalar()
    oc = F.col(order_col)
    d = df.withColumn("_bounds", bounds)
    d = d.withColumn("_pid", F.size(F.filter("_bounds", lambda x: x < oc))).drop("_bounds")
    tot = d.groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    po = F.col("_pid").desc() if descending else F.col("_pid").asc()
    wb = Window.orderBy(po).rowsBetween(Window.unboundedPreceding, -1)  # <= `buckets` rows
    offs = tot.select("_pid", *[F.coalesce(F.sum(f"_t_{v}").over(wb), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    w = Window.partitionBy("_pid").orderBy(oc.desc() if descending else oc.asc()).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(F.broadcast(offs), "_pid")  # `offs` has at most `buckets` rows
    return out.select(
        *df.columns, "_pid", *[(F.col(f"_o_{v}") + F.sum(v).over(w)).alias(f"cum_{v}") for v in value_cols]
    )


def score_histogram(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(score, pos, neg) per distinct score (partial aggregation)."""
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )


def auc(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve (Mann-Whitney, ties count one half).  NULL
    when only one class is present."""
    h = score_histogram(scored, y, score)
    c = running_totals(h, "score", ["neg"], descending=False)
    part = c.agg(
        F.sum(F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") * 0.5)).alias("_num"),
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
    )
    return part.select(F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_num") / (F.col("_p") * F.col("_n"))).alias("auc"))


def evaluate(scored: DataFrame, threshold: float = 0.5, y: str = "y", score: str = "score") -> DataFrame:
    """auc, precision, recall, f1, confusion counts, false_positive_rate,
    positive_rate and n_samples at one threshold (one row)."""
    s = _nan_low(F.col(score))
    base = _rates(
        scored.agg(
            F.count_if((s >= threshold) & (F.col(y) == 1)).alias("tp"),
            F.count_if((s >= threshold) & (F.col(y) != 1)).alias("fp"),
            F.count_if((s < threshold) & (F.col(y) != 1)).alias("tn"),
            F.count_if((s < threshold) & (F.col(y) == 1)).alias("fn"),
            F.count(F.lit(1)).alias("n_samples"),
            F.avg(F.col(y).cast("double")).alias("positive_rate"),
        )
    )
    a = auc(scored, y, score).select("auc").scalar()
    return base.select(
        a.alias("auc"),
        "precision",
        "recall",
        "f1",
        F.lit(threshold).alias("threshold"),
        "n_samples",
        "positive_rate",
        F.col("tp").alias("true_positives"),
        F.col("fp").alias("false_positives"),
        F.col("tn").alias("true_negatives"),
        F.col("fn").alias("false_negatives"),
        _div0(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double")).alias("false_positive_rate"),
    )


def threshold_sweep(
    scored: DataFrame, thresholds: list[float] | None = None, y: str = "y", score: str = "score", with_auc: bool = True
) -> DataFrame:
    """``evaluate`` at every threshold in one pass over the data."""
    ts = sorted(thresholds or DEFAULT_SWEEP)
    arr = F.array(*[F.lit(float(t)) for t in ts])
    sc = _nan_low(F.col(score))
    # bucket b = number of thresholds <= score, so score >= t_j <=> b > j.
    # One pass: a histogram over at most len(ts)+1 buckets (partial agg) ...
    hist = scored.select(F.size(F.filter(arr, lambda t: t <= sc)).alias("b"), (F.col(y) == 1).alias("pos")).groupBy("b").agg(
        F.count_if("pos").alias("pos"), F.count_if(~F.col("pos")).alias("neg")
    )
    # ... then every threshold's counts from that tiny table in one aggregate.
    per_t = []
    for j, t in enumerate(ts):
        per_t.append(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.coalesce(F.sum(F.when(F.col("b") > j, F.col("pos"))), F.lit(0)).alias("tp"),
                F.coalesce(F.sum(F.when(F.col("b") > j, F.col("neg"))), F.lit(0)).alias("fp"),
            )
        )
    wide = hist.agg(F.array(*per_t).alias("m"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    out = wide.select(F.explode("m").alias("r"), "P", "N").select("r.*", "P", "N").select(
        "threshold",
        F.col("tp"),
        F.col("fp"),
        (F.col("N") - F.col("fp")).alias("tn"),
        (F.col("P") - F.col("tp")).alias("fn"),
        (F.col("P") + F.col("N")).alias("n_samples"),
        (F.col("P") / (F.col("P") + F.col("N"))).alias("positive_rate"),
    )
    out = _rates(out).withColumn(
        "false_positive_rate", _div0(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double"))
    )
    if with_auc:
        out = out.withColumn("auc", auc(scored, y, score).select("auc").scalar())
    return out


def optimal_threshold(
    scored: DataFrame,
    optimize_for: str = "f1",
    min_precision: float | None = None,
    y: str = "y",
    score: str = "score",
    fallback: float = 0.9,
) -> DataFrame:
    """Best threshold over 0.01..0.99 (lowest wins ties); if
    ``min_precision`` leaves nothing, the fallback threshold's metrics."""
    sw = threshold_sweep(scored, FINE_SWEEP, y, score, with_auc=False)
    cand = sw.filter(F.col("precision") >= min_precision) if min_precision else sw
    best = cand.orderBy(F.col(optimize_for).desc(), F.col("threshold").asc()).limit(1)
    fb = threshold_sweep(scored, [fallback], y, score, with_auc=False)
    has = cand.select(F.count(F.lit(1)) > 0).scalar()
    return best.withColumn("fallback", F.lit(False)).unionByName(fb.withColumn("fallback", F.lit(True))).filter(
        F.col("fallback") != has
    )


def archive_precision(
    scored: DataFrame, thresholds: list[float] | None = None, y: str = "y", score: str = "score"
) -> DataFrame:
    """Archive = score < t (strict).  Per threshold: precision of archiving
    (share with y = 0), n archived, false positives and their rate."""
    ts = thresholds or ARCHIVE_THRESHOLDS
    aggs = []
    for i, t in enumerate(ts):
        arch = F.col(score) < F.lit(float(t))
        aggs += [F.count_if(arch).alias(f"n{i}"), F.count_if(arch & (F.col(y) == 0)).alias(f"c{i}"), F.count_if(arch & (F.col(y) == 1)).alias(f"f{i}")]
    one = scored.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("archive_threshold"),
                    F.col(f"n{i}").alias("n_archived"),
                    F.col(f"c{i}").alias("correct"),
                    F.col(f"f{i}").alias("n_false_positives"),
                )
                for i, t in enumerate(ts)
            ]
        )
    )
    e = one.select(rows.alias("r")).select("r.*")
    return e.select(
        "archive_threshold",
        _div0(F.col("correct").cast("double"), F.col("n_archived").cast("double")).alias("archive_precision"),
        "n_archived",
        "n_false_positives",
        _div0(F.col("n_false_positives").cast("double"), F.col("n_archived").cast("double")).alias("false_positive_rate"),
    )


def _descending_curve(scored: DataFrame, y: str, score: str) -> DataFrame:
    """Per distinct score (descending): tps, fps = positives/negatives with
    score >= this score, plus the next-lower score's increments."""
    h = score_histogram(scored, y, score)
    c = running_totals(h, "score", ["pos", "neg"], descending=True)
    w = Window.partitionBy("_pid").orderBy(F.col("score").desc())
    c = c.withColumn("_next_pos", F.lead("pos").over(w)).withColumn("_next_neg", F.lead("neg").over(w))
    # First row of each bucket, handed to the last row of the previous bucket.
    firsts = c.groupBy("_pid").agg(F.max_by(F.struct("pos", "neg"), "score").alias("_first"))
    nb = firsts.select(
        "_pid", F.lag("_first").over(Window.orderBy(F.col("_pid").asc())).alias("_nb_first")
    )  # bounded: one row per range bucket
    c = c.join(F.broadcast(nb), "_pid", "left")
    return c.select(
        "score",
        "pos",
        "neg",
        F.col("cum_pos").alias("tps"),
        F.col("cum_neg").alias("fps"),
        F.coalesce("_next_pos", F.col("_nb_first.pos")).alias("next_pos"),
        F.coalesce("_next_neg", F.col("_nb_first.neg")).alias("next_neg"),
    )


def roc_curve(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score (descending),
    collinear intermediate points dropped, plus (0, 0) at +inf."""
    c = _descending_curve(scored, y, score)
    tot = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.max("score").alias("top"))
    P = tot.select("P").scalar()
    N = tot.select("N").scalar()
    top = tot.select("top").scalar()
    last = F.col("next_pos").isNull()
    first = F.col("score") == top
    corner = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    pts = c.filter(first | last | corner).select(
        F.col("score").alias("threshold"),
        # NULL when a class is absent
        F.try_divide("fps", N).alias("fpr"),
        F.try_divide("tps", P).alias("tpr"),
    )
    spark = scored.sparkSession
    origin = spark.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def pr_curve(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the terminal
    (precision 1, recall 0) point with a NULL threshold."""
    c = _descending_curve(scored, y, score)
    P = c.agg(F.sum("pos")).scalar()
    ps = F.col("tps") + F.col("fps")
    pts = c.select(
        F.col("score").alias("threshold"),
        F.when(ps != 0, F.col("tps") / ps).otherwise(F.lit(0.0)).alias("precision"),
        F.when(P == 0, F.lit(1.0)).otherwise(F.col("tps") / P).alias("recall"),
    )
    spark = scored.sparkSession
    end = spark.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def score_summary(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    s = F.col(score)
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(s).alias("mean_score"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.count_if(s >= 0.7).alias("high_keep"),
        F.count_if(s <= 0.3).alias("high_archive"),
        F.count_if((s > 0.3) & (s < 0.7)).alias("low_confidence"),
        F.count_if(((s >= 0.5) & (F.col(y) == 1)) | ((s < 0.5) & (F.col(y) != 1))).alias("correct"),
    ).select(
        "n", "mean_score", "min_score", "max_score", "high_keep", "high_archive", "low_confidence",
        F.try_divide("correct", "n").alias("accuracy"),
    )


def classification_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per label precision/recall/f1/support plus 'macro avg' and
    'weighted avg' rows; labels = those seen in truth or predictions."""
    pairs = predictions.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    true_n = pairs.groupBy(F.col("t").alias("cls")).agg(F.sum("n").alias("support"))
    pred_n = pairs.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    hit = pairs.filter(F.col("t") == F.col("p")).select(F.col("t").alias("cls"), F.col("n").alias("tp"))
    per = (
        true_n.join(pred_n, "cls", "full")
        .join(hit, "cls", "left")
        .select(
            "cls",
            F.coalesce("support", F.lit(0)).alias("support"),
            F.coalesce("predicted", F.lit(0)).alias("predicted"),
            F.coalesce("tp", F.lit(0)).alias("tp"),
        )
    )
    per = per.select(
        F.col("cls").alias("label"),
        _div0(F.col("tp").cast("double"), F.col("predicted").cast("double")).alias("precision"),
        _div0(F.col("tp").cast("double"), F.col("support").cast("double")).alias("recall"),
        "support",
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    tot = per.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum("support").alias("s"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"),
    )
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("s").alias("support"), F.col("mf").alias("f1"))
    weighted = tot.select(
        F.lit("weighted avg").alias("label"),
        _div0(F.col("wp"), F.col("s").cast("double")).alias("precision"),
        _div0(F.col("wr"), F.col("s").cast("double")).alias("recall"),
        F.col("s").alias("support"),
        _div0(F.col("wf"), F.col("s").cast("double")).alias("f1"),
    )
    return per.unionByName(macro).unionByName(weighted)
