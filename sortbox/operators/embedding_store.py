"""Embeddings stored by content: each distinct text is encoded once, in this run or an earlier one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import path_exists
from . import ml as ML


def stored_vectors(spark, vectors_dir: str, encoder: str) -> DataFrame | None:
    """(text_hash, vector) of an encoder, one row per text; None when nothing is stored."""
    if not path_exists(spark, vectors_dir):
        return None
    rows = spark.read.parquet(vectors_dir).filter(F.col("encoder") == encoder)
    # A run that was cut off may have stored a text that the next one stored again.
    return rows.groupBy("text_hash").agg(F.max("vector").alias("vector"))


def embed_by_content(
    df: DataFrame,
    text_cols: dict[str, str],
    encoder: str,
    vectors_dir: str,
    encoder_factory: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None,
    dims: int = 384,
    batch_size: int = 32,
    max_chars: int | None = None,
) -> DataFrame:
    """Adds a vector column for each text column (``text_cols``: text column -> vector column).

    Texts are cleaned up as in ``ml.embed_text``; blank and NULL texts have no vector and are not
    encoded.  Texts without a stored vector of ``encoder`` (a name for the model and its version) are
    encoded once each and appended to ``vectors_dir``, a folder that all executors share; then all rows
    take their vectors from there.  Equal texts of different columns share one vector."""
    spark = df.sparkSession

    def clean(name: str):
        return C.prepare_text(F.coalesce(F.col(name), F.lit("")), max_chars)

    def text_hash(name: str):
        return F.when(F.trim(clean(name)) != "", F.sha2(clean(name), 256))

    pairs = F.array(*[F.struct(text_hash(c).alias("text_hash"), clean(c).alias("text")) for c in text_cols])
    texts = df.select(F.inline(pairs)).filter("text_hash is not null").dropDuplicates(["text_hash"])
    known = stored_vectors(spark, vectors_dir, encoder)
    if known is not None:
        texts = texts.join(known.select("text_hash"), "text_hash", "left_anti")
    new = ML.embed_text(texts, "text", "vector", encoder_factory, dims, batch_size)
    new.select(F.lit(encoder).alias("encoder"), "text_hash", "vector").write.mode("append").parquet(vectors_dir)
    known = stored_vectors(spark, vectors_dir, encoder)
    out = df
    for name, vector in text_cols.items():
        mine = known.select(F.col("text_hash").alias("_text_hash"), F.col("vector").alias(vector))
        out = out.withColumn("_text_hash", text_hash(name)).join(mine, "_text_hash", "left").drop("_text_hash")
    return out.select(*df.columns, *text_cols.values())
