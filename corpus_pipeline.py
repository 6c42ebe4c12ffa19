"""Corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes all that the one before it kept, as a table, and its decisions take effect: documents
go, or lose the words of repeated passages.  All stages but the last return the columns of
``documents``; other columns are not carried on.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortbox.llm import decontamination, language_id, near_dup, packing, substring_dedup
from sortbox.llm.tables import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no letters, or null) go; ``lang`` stays as it is given."""
    found = language_id.identify(docs, keep=COLUMNS)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles) stays.

    Of rows that repeat an id and its text one stays.  Rows without an id stay.
    """
    gone = near_dup.near_duplicates(docs, k=5).where("not kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all documents but the first; a text that is all repeats goes."""
    cut = substring_dedup.remove_repeats(docs, keep=["lang", "source"], whole_text=True)
    left = cut.where("n_words = 0 or n_removed < n_words").withColumnRenamed("kept_text", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of ``benchmark`` go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.with_hits(docs, items, COLUMNS).where(F.size("hits") == 0).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pack_documents(docs, added=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]
ORACLE_SQL = None  # language, signatures and the latent space have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
