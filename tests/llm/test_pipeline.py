"""The pipeline against the operators' brute-force versions, stage by stage."""

import re

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import awkward, rng, sentence, words
from tests.llm.test_dedup import brute_components, brute_repeats
from tests.llm.test_text_ops import reference_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def corpus(r):
    passage, base = sentence(r, 70), sentence(r, 90)
    items = [(k, sentence(r, 25) + ".") for k in range(5)]
    rows = [(i, t) for i, t in enumerate(awkward(r))]
    rows += [(100 + i, sentence(r, 40) + "\n" + passage + "\n" + sentence(r, 20)) for i in range(4)]
    rows += [(200 + i, base if i < 3 else base.upper()) for i in range(5)]
    near = base.split()[:45]  # one inner word changed: alike by four-word shingles, not by five
    rows += [(250, " ".join(near)), (251, " ".join([*near[:22], "changed", *near[23:]]))]
    rows += [(300 + i, sentence(r, 30) + " " + items[i][1] + " " + sentence(r, 30)) for i in range(5)]
    rows += [(400 + i, sentence(r, 50)) for i in range(30)] + [(500, passage)]
    return [(i, t, "en" if i % 2 else "de", "src0", len(t or ""), 1) for i, t in rows], items


def test_stages_and_their_order(spark, tmp_path):
    rows, items = corpus(rng(50))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == corpus_pipeline.COLUMNS and docs.where("n_chars <> length(text)").isEmpty()
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    before = {r[0]: r[1] for r in rows}
    assert kept["language_id"] == {i: t for i, t in before.items() if any(c.isalpha() for c in t or "")}
    components = brute_components(list(kept["language_id"].items()), 5)
    assert kept["near_dedup"] == {i: t for i, t in kept["language_id"].items() if components[i][1] == i}
    assert {250, 251} <= set(kept["near_dedup"])
    removed = {i: (n, m) for i, n, m, _ in brute_repeats(list(kept["near_dedup"].items()), 50)}
    assert set(kept["substring_dedup"]) == {i for i, (n, m) in removed.items() if m < n} and 500 not in kept["substring_dedup"]
    for i, t in kept["substring_dedup"].items():
        n, m = removed[i]
        assert len(words(t)) == n - m and (m or t == kept["near_dedup"][i])
    assert set(kept["decontamination"]) == set(kept["substring_dedup"]) - {300 + k for k in range(5)}

    out = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {x.doc_id: (x.n, x["all"]) for x in out} == {i: (len(ids), len(ids)) for i, t in kept["decontamination"].items() for ids in [reference_ids(t)]}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    rows, items = corpus(rng(51))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_that_repeat_an_id_and_its_text(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7, 0), (1, "a b c d", "en", "s", 7, 0), (None, "x y z w", "en", "s", 7, 0)], SCHEMA)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "None"]


def test_registration():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    numbers = {k.split("_")[0] for k in q if re.match(r"op\d+_", k)}
    assert numbers == {f"op{n}" for n in range(1, 14)} and "pipeline" in q
    assert {k.split("_")[0] for k in o if re.match(r"op\d+_", k)} == {"op4", "op5", "op6", "op8", "op9", "op11", "op13"}
