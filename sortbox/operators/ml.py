"""ML operators on MLlib: training matrix, stratified split, the
importance model (gradient-boosted trees), the semantic label classifier
(weighted multinomial logistic regression), scoring, embeddings and model /
metrics persistence.

Model-quality numbers can only be compared at the metric level with the
application's LightGBM / scikit-learn models, never score by score.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from . import boosting as BO
from . import evaluation as EV

METADATA_FEATURES = ["is_newsletter", "day_of_week", "hour_of_day", "subject_length", "body_length"]
HISTORICAL_FEATURES = ["sender_email_count", "sender_open_rate", "sender_days_since_last", "domain_open_rate"]
NO_PREVIOUS_DAYS = 999.0
SPLIT_SEED = 42
SPLIT_BUCKETS = 4096


def _non_empty(a: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0)


def combine_embeddings(subject: Column, body: Column) -> Column:
    """Mean of subject and body embeddings (truncated to the shorter one),
    else whichever is present, else NULL."""
    n = F.least(F.size(subject), F.size(body))
    both = F.zip_with(F.slice(subject, 1, n), F.slice(body, 1, n), lambda s, b: (s + b) / 2)
    return F.when(_non_empty(subject) & _non_empty(body), both).when(_non_empty(subject), subject).when(_non_empty(body), body)


def training_matrix(
    emails: DataFrame, features: DataFrame, use_embeddings: bool = True, min_sender_count: int = 2
) -> DataFrame:
    """message_id, the 9 model features (NULL -> 0, no previous mail ->
    999), ``emb`` (combined embedding, only with ``use_embeddings``; rows
    without any embedding are then dropped) and ``y`` = was_read."""
    j = emails.select("message_id", "was_read").join(features, "message_id").filter(
        F.col("sender_email_count") >= min_sender_count
    )
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in METADATA_FEATURES]
    for c in HISTORICAL_FEATURES:
        fill = NO_PREVIOUS_DAYS if c == "sender_days_since_last" else 0.0
        cols.append(F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c))
    out = j.select("message_id", *cols, F.col("was_read").cast("int").alias("y"), "subject_embedding", "body_embedding")
    if use_embeddings:
        out = out.withColumn("emb", combine_embeddings(F.col("subject_embedding"), F.col("body_embedding"))).filter(
            F.col("emb").isNotNull()
        )
    return out.drop("subject_embedding", "body_embedding")


def inference_matrix(features: DataFrame, emb_dims: int | None = None) -> DataFrame:
    """message_id and the model features of *every* feature row.

    As at scoring time in the application: missing numbers as in
    ``training_matrix``, a missing embedding as zeros (``emb_dims`` is the
    width the model was trained with; None for a model without embeddings).
    A shorter embedding is padded with zeros, a longer one cut to the width.
    """
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in METADATA_FEATURES]
    for c in HISTORICAL_FEATURES:
        fill = NO_PREVIOUS_DAYS if c == "sender_days_since_last" else 0.0
        cols.append(F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c))
    if not emb_dims:
        return features.select("message_id", *cols)
    zeros = F.array_repeat(F.lit(0.0), emb_dims)
    emb = combine_embeddings(F.col("subject_embedding"), F.col("body_embedding"))
    emb = F.slice(F.concat(F.coalesce(emb, F.array().cast("array<double>")), zeros), 1, emb_dims)
    return features.select("message_id", *cols, emb.alias("emb"))


def embedding_width(matrix: DataFrame) -> int | None:
    """Width of the training matrix' embeddings (None without any)."""
    if "emb" not in matrix.columns:
        return None
    row = matrix.select(F.size("emb").alias("n")).first()
    return row["n"] if row else None


def score_emails(model: PipelineModel, features: DataFrame, emb_dims: int | None) -> DataFrame:
    """message_id and ``score`` of every feature row."""
    return score_rows(model, inference_matrix(features, emb_dims)).select("message_id", "score")


def stratified_split(
    df: DataFrame, label: str = "y", test_fraction: float = 0.2, seed: int = SPLIT_SEED, key: str = "message_id",
    buckets: int = SPLIT_BUCKETS,
) -> DataFrame:
    """Adds ``is_test``: exactly ceil(test_fraction * n_class) rows of each
    class, the ones with the smallest md5 of ``key:seed``.

    Deterministic and identical on re-runs.  No window runs over a whole
    class: rows are counted per (class, hash bucket), the cut-off bucket of
    each class is found on that small table, and only rows of the cut-off
    bucket are ranked.
    """
    h = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")))
    # bucket by the first 24 bits of the hash: order of buckets = order of hashes
    h = h.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 6), 16, 10).cast("bigint") * buckets / (1 << 24)).cast("int"))
    per = h.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    tot = per.groupBy(label).agg(F.sum("_n").alias("_tot"))
    wb = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # <= `buckets` rows per class
    per = per.join(tot, label).withColumn("_before", F.coalesce(F.sum("_n").over(wb), F.lit(0)))
    per = per.withColumn("_k", F.ceil(F.col("_tot") * F.lit(test_fraction)))
    per = per.select(
        label, "_b",
        F.when(F.col("_before") + F.col("_n") <= F.col("_k"), F.lit("all"))
        .when(F.col("_before") >= F.col("_k"), F.lit("none"))
        .otherwise(F.lit("cut")).alias("_state"),
        (F.col("_k") - F.col("_before")).alias("_take"),
    )
    # One row per (class, bucket): small for two classes, but it grows with
    # the number of classes, so AQE decides whether to broadcast it.
    j = h.join(per, [label, "_b"])
    # Only the cut-off bucket of each class is ranked (about 1/buckets of
    # the rows); every other row is decided by its bucket alone.
    w = Window.partitionBy(label, "_b").orderBy("_h", key)
    cut = j.filter(F.col("_state") == "cut").withColumn("_r", F.row_number().over(w))
    cut = cut.withColumn("is_test", F.col("_r") <= F.col("_take")).drop("_r")
    rest = j.filter(F.col("_state") != "cut").withColumn("is_test", F.col("_state") == "all")
    return rest.unionByName(cut).drop("_h", "_b", "_state", "_take")


def feature_columns(df: DataFrame) -> list[str]:
    return METADATA_FEATURES + HISTORICAL_FEATURES + (["emb_vec"] if "emb" in df.columns else [])


def _with_vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("emb_vec", array_to_vector("emb")) if "emb" in df.columns else df


def train_importance_model(
    matrix: DataFrame, max_iter: int = 200, validation_tol: float = 1e-4, seed: int = SPLIT_SEED
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Gradient-boosted trees on the training matrix (stratified 80/20;
    the test part is the validation set for early stopping).

    Returns (model, test predictions with ``score``, one-row metrics).
    """
    split = stratified_split(matrix, "y", 0.2, seed)
    data = _with_vectors(split).withColumn("label", F.col("y").cast("double"))
    # The matrix has no NULLs (filled above), so the default "error" mode holds.
    assembler = VectorAssembler(inputCols=feature_columns(split), outputCol="features")
    gbt = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=max_iter, stepSize=0.05, maxDepth=5, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", validationIndicatorCol="is_test", validationTol=validation_tol, seed=seed,
    )
    model = Pipeline(stages=[assembler, gbt]).fit(data)
    test = score_rows(model, data.filter("is_test"))
    m = EV.evaluate(test, 0.5)
    metrics = m.select(
        "auc",
        "precision",
        "recall",
        split.agg(F.count_if(~F.col("is_test"))).scalar().alias("samples_train"),
        split.agg(F.count_if("is_test")).scalar().alias("samples_test"),
        F.lit(len(feature_columns(split))).alias("features"),
    )
    return model, test, metrics


def scalar_features(df: DataFrame, emb_dims: int | None) -> tuple[DataFrame, list[str]]:
    """The matrix with one array column ``x`` of all features, and their names."""
    scalars = METADATA_FEATURES + HISTORICAL_FEATURES
    x = F.array(*[F.col(c) for c in scalars])
    if emb_dims:
        zeros = F.array_repeat(F.lit(0.0), emb_dims)
        x = F.concat(x, F.slice(F.concat(F.col("emb"), zeros), 1, emb_dims))
    return df.withColumn("x", x), scalars + [f"emb_{i}" for i in range(emb_dims or 0)]


def train_leafwise_model(matrix: DataFrame, settings: BO.Settings | None = None) -> tuple[BO.Model, DataFrame, DataFrame]:
    """The application's own boosting on the training matrix (see ``boosting``): stratified 80/20,
    trees of 31 leaves, stopped by the AUC of the test part.

    Returns (model, test predictions with ``score``, one-row metrics)."""
    settings = settings or BO.Settings()
    # Training reads the rows many times: the matrix' joins and the split run once.
    matrix = BO.stored(matrix)
    split = BO.stored(stratified_split(matrix, "y", 0.2, settings.seed))
    data, names = scalar_features(split, embedding_width(matrix))
    model = BO.fit(data, names, settings)
    test = BO.score(model, data.filter("is_test")).drop("x")
    metrics = EV.evaluate(test, 0.5).select(
        "auc",
        "precision",
        "recall",
        split.agg(F.count_if(~F.col("is_test"))).scalar().alias("samples_train"),
        split.agg(F.count_if("is_test")).scalar().alias("samples_test"),
        F.lit(len(names)).alias("features"),
        F.lit(len(model.trees)).alias("trees"),
    )
    return model, test, metrics


def score_emails_leafwise(model: BO.Model, features: DataFrame) -> DataFrame:
    """message_id and ``score`` of every feature row."""
    dims = len(model.names) - len(METADATA_FEATURES + HISTORICAL_FEATURES)
    data, _ = scalar_features(inference_matrix(features, dims or None), dims or None)
    return BO.score(model, data).select("message_id", "score")


def leafwise_importance(spark: SparkSession, model: BO.Model, top_n: int = 20) -> DataFrame:
    """Top-n features by their share of the splits' gain."""
    df = spark.createDataFrame(list(model.importance().items()), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top_n)


def score_rows(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``score`` = probability of class 1."""
    out = model.transform(_with_vectors(df) if "emb_vec" not in df.columns else df)
    return out.withColumn("score", vector_to_array(F.col("probability"))[1]).drop("rawPrediction", "probability", "prediction", "features")


def model_scorer(model: PipelineModel, emb_dims: int | None) -> Callable[[DataFrame], DataFrame]:
    """A scorer for the triage job: features -> (message_id, score)."""
    return lambda features: score_emails(model, features, emb_dims)


def feature_importance(spark: SparkSession, model: PipelineModel, names: list[str], top_n: int = 20) -> DataFrame:
    """Top-n features by importance (embedding slots named emb_<i>)."""
    gbt = model.stages[-1]
    imp = gbt.featureImportances.toArray().tolist()
    scalars = [n for n in names if n != "emb_vec"]
    expanded = scalars + [f"emb_{i}" for i in range(len(imp) - len(scalars))]
    rows = list(zip(expanded, imp))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top_n)


def train_semantic_classifier(
    training: DataFrame, min_samples: int = 3, test_fraction: float = 0.2, seed: int = SPLIT_SEED, max_iter: int = 1000
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Multinomial logistic regression on subject embeddings with balanced
    class weights n / (k * n_c) and L2 strength C = 1 (regParam = 1 / n).

    ``training``: (message_id, label, subject_embedding).  Labels with fewer
    than ``min_samples`` rows are dropped.  Returns (model, test
    predictions, one-row metrics)."""
    support = training.groupBy("label").agg(F.count(F.lit(1)).alias("_nc")).filter(F.col("_nc") >= min_samples)
    kept = training.join(support.select("label"), "label", "left_semi")
    split = stratified_split(kept, "label", test_fraction, seed)
    # One aggregate gives every number the fit needs; weights come from the
    # training rows only.
    counts = split.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_test")).alias("train"))
    n, k, n_train = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum("train")).first()
    if (n or 0) < 10:
        raise ValueError(f"a semantic classifier is fitted on 10 labelled mails or more; there are {n or 0}")
    weight = F.lit(float(n_train)) / (F.lit(float(k)) * F.col("train"))
    split = split.join(counts.select("label", "train"), "label").withColumn("weight", F.coalesce(weight, F.lit(0.0))).drop("train")
    split = split.withColumn("features", array_to_vector("subject_embedding"))
    indexer = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc")
    lr = LogisticRegression(
        featuresCol="features", labelCol="label_idx", weightCol="weight", family="multinomial", maxIter=max_iter,
        regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False,
    )
    model = Pipeline(stages=[indexer, lr]).fit(split.filter(~F.col("is_test")))
    test = predict_semantic(model, split.filter("is_test"))
    metrics = test.agg(
        F.avg((F.col("label") == F.col("sem_label")).cast("double")).alias("accuracy"),
    ).select("accuracy", F.lit(n).alias("n_samples"), F.lit(k).alias("n_classes"))
    return model, test, metrics


def _labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict_semantic(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``sem_label`` (argmax class) and ``sem_confidence``."""
    if "features" not in df.columns:
        df = df.withColumn("features", array_to_vector("subject_embedding"))
    labels = F.array(*[F.lit(x) for x in _labels_of(model)])
    lr = model.stages[-1]
    out = lr.transform(df).withColumn("_p", vector_to_array("probability"))
    best = F.array_position(F.col("_p"), F.array_max("_p"))
    return out.withColumn("sem_label", F.element_at(labels, best.cast("int"))).withColumn(
        "sem_confidence", F.array_max("_p")
    ).drop("rawPrediction", "probability", "prediction", "_p")


def top_k_labels(model: PipelineModel, df: DataFrame, k: int = 3) -> DataFrame:
    """Adds ``top_k``: the k most probable labels, most probable first."""
    if "features" not in df.columns:
        df = df.withColumn("features", array_to_vector("subject_embedding"))
    labels = F.array(*[F.lit(x) for x in _labels_of(model)])
    out = model.stages[-1].transform(df).withColumn("_p", vector_to_array("probability"))
    pairs = F.arrays_zip(F.col("_p").alias("p"), labels.alias("label"))
    ranked = F.slice(F.reverse(F.array_sort(pairs)), 1, k)
    return out.withColumn("top_k", F.transform(ranked, lambda x: F.struct(x["label"].alias("label"), x["p"].alias("confidence")))).drop(
        "rawPrediction", "probability", "prediction", "_p"
    )


# ---------------------------------------------------------------------------
# Embeddings
# ---------------------------------------------------------------------------

_ENCODERS: dict[str, object] = {}  # of a worker, by the calls of ``embed_text`` that need them


def embed_text(
    df: DataFrame,
    text_col: str,
    out_col: str,
    encoder_factory: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None,
    dims: int = 384,
    batch_size: int = 32,
    max_chars: int | None = None,
) -> DataFrame:
    """Encode non-empty texts; empty or NULL text -> NULL.

    Texts are cleaned up first (white space, ends); ``max_chars`` cuts them
    for an encoder with a bounded input, by default the whole text counts.

    With ``encoder_factory`` the texts go through ``mapInPandas`` in Arrow
    batches; the factory runs once per Python worker (the loaded model is
    cached there).  Without it, a JVM-side hashing encoder (token counts
    hashed into ``dims`` slots, L2-normalised) stands in, since no model
    files are available offline.
    """
    if encoder_factory is None:
        tok = Tokenizer(inputCol="_t", outputCol="_tok")
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dims)
        nm = Normalizer(inputCol="_tf", outputCol="_n", p=2.0)
        x = df.withColumn("_t", C.prepare_text(F.coalesce(F.col(text_col), F.lit("")), max_chars))
        x = nm.transform(tf.transform(tok.transform(x)))
        return x.withColumn(out_col, F.when(F.trim(F.col("_t")) != "", vector_to_array("_n"))).drop("_t", "_tok", "_tf", "_n")

    # A worker outlives a query, and the driver's object numbers repeat: each call has a key of its own.
    key = uuid.uuid4().hex
    kept = df.columns
    df = df.withColumn("_t", C.prepare_text(F.coalesce(F.col(text_col), F.lit("")), max_chars))
    text_col = "_t"
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _ENCODERS.get(key)
        if enc is None:
            enc = encoder_factory()
            _ENCODERS.clear()  # one loaded encoder at a time
            _ENCODERS[key] = enc
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str)
            mask = texts.str.strip() != ""
            vecs: list = [None] * len(pdf)
            idx = [i for i, m in enumerate(mask) if m]
            for s in range(0, len(idx), batch_size):
                chunk = idx[s : s + batch_size]
                out = enc([texts.iloc[i] for i in chunk])
                for i, v in zip(chunk, out):
                    vecs[i] = [float(z) for z in v]
            pdf = pdf.copy()
            pdf[out_col] = vecs
            yield pdf

    return df.mapInPandas(run, schema).select(*kept, out_col)


def embed_mail(df: DataFrame, encoder_factory=None, dims: int = 384, max_chars: int | None = None) -> DataFrame:
    """(message_id, subject_embedding, body_embedding): the cleaned-up
    subject, and the cleaned-up plain body or else the snippet."""
    src = df.select("message_id", "subject", C.body_source("body_plain", "snippet").alias("_body"))
    out = embed_text(src, "subject", "subject_embedding", encoder_factory, dims, max_chars=max_chars)
    out = embed_text(out, "_body", "body_embedding", encoder_factory, dims, max_chars=max_chars)
    return out.select("message_id", "subject_embedding", "body_embedding")


# ---------------------------------------------------------------------------
# Persistence
# ---------------------------------------------------------------------------


def save_model(model: PipelineModel, base_path: str, version: str, feature_names: list[str]) -> str:
    """Versioned model directory: ``<base>/<version>``; the feature order is
    stored next to it (and lives inside the pipeline's assembler too)."""
    path = f"{base_path.rstrip('/')}/{version}"
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(feature_names),)], "feature_names string").coalesce(1).write.mode("overwrite").json(
        f"{path}/feature_config"
    )
    return path


def _list_dirs(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(hpath) if st.isDirectory())


def load_model(spark: SparkSession, base_path: str, version: str = "latest") -> tuple[PipelineModel, list[str]]:
    """Load a version; 'latest' is the lexicographically last one."""
    if version == "latest":
        versions = _list_dirs(spark, base_path)
        if not versions:
            raise FileNotFoundError(f"no model under {base_path}")
        version = versions[-1]
    path = f"{base_path.rstrip('/')}/{version}"
    names = json.loads(spark.read.json(f"{path}/feature_config").first()["feature_names"])
    return PipelineModel.load(path), names


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
