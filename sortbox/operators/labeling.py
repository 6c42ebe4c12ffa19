"""A labeller's run: from candidate mail to prompts, answers, labels and a quarantine.

``label_mail`` renders one prompt per mail, has each distinct prompt answered once, stores the answers
and joins them back to the mail.  The labeller is the caller's: a factory without arguments that is
called once per task and returns ``list[str] -> list[str | None]``.

* **Batches.**  ``batch_size`` prompts go to the labeller at a time.
* **Retries.**  A batch that raises, or gives another number of answers than it has prompts, is tried
  again up to ``retries`` times with growing pauses.  After that its prompts go one by one, so that one
  bad prompt does not cost its neighbours their labels.
* **Quarantine.**  A prompt that fails by itself, has no answer or an answer without a label is stored
  with its error.  Its mail gets no label and is tried again by the next run.
* **Recovery.**  Answers are stored under (model, prompt).  A run asks only for prompts without a label
  of that model, so a run that follows a lost one pays for the rest only, and a repeated run for nothing.
* **Rate.**  ``tasks`` bounds how many labellers work at the same time, ``pause`` is the time between
  the calls of one of them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.tables import path_exists
from .lookups import label_prompts

Labeler = Callable[[list[str]], list[str | None]]

ANSWERS = "prompt string, answer string, error string, attempts int"


def prompt_text(sender: str = "sender", subject: str = "subject", snippet: str = "snippet") -> Column:
    """The prompt of a mail, three lines; white space inside a field becomes one space."""
    one_line = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return F.concat(F.lit("From: "), one_line(sender), F.lit("\nSubject: "), one_line(subject), F.lit("\nPreview: "), one_line(snippet))


def _ask(labeler: Labeler, prompts: list[str], retries: int, wait: float) -> tuple[list[str | None] | None, str | None, int]:
    """Answers of a batch, or the last error, and the number of attempts."""
    error = None
    for attempt in range(1, retries + 2):
        try:
            answers = list(labeler(prompts))
            if len(answers) == len(prompts):
                return answers, None, attempt
            error = f"{len(answers)} answers to {len(prompts)} prompts"
        except Exception as e:  # a labeller may fail in any way; the error is kept in the quarantine
            error = f"{type(e).__name__}: {e}"
        if attempt <= retries:
            time.sleep(wait * 2 ** (attempt - 1))
    return None, error, retries + 1


def answer_batch(labeler: Labeler, prompts: list[str], retries: int, wait: float) -> list[tuple[str | None, str | None, int]]:
    """(answer, error, attempts) of each prompt."""
    answers, error, attempts = _ask(labeler, prompts, retries, wait)
    if answers is None:
        if len(prompts) == 1:
            return [(None, error, attempts)]
        single = [answer_batch(labeler, [p], retries, wait)[0] for p in prompts]
        return [(a, e, attempts + n) for a, e, n in single]
    return [(a, None if a is not None else "no answer", attempts) for a in answers]


def answer_prompts(
    prompts: DataFrame,
    labeler_factory: Callable[[], Labeler],
    batch_size: int = 32,
    retries: int = 3,
    wait: float = 0.5,
    pause: float = 0.0,
    tasks: int | None = None,
) -> DataFrame:
    """Answers to a table of distinct prompts (column ``prompt``), as ``ANSWERS``.  Lazy: every action
    on the result asks again, so it is to be written before it is used twice (``label_mail`` does)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), batch_size):
                if labeler is None:
                    labeler = labeler_factory()
                elif pause:
                    time.sleep(pause)
                part = texts[i : i + batch_size]
                answers, errors, attempts = zip(*answer_batch(labeler, part, retries, wait), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(attempts, pa.int32())],
                    ["prompt", "answer", "error", "attempts"],
                )

    rows = prompts.select("prompt")
    return (rows.repartition(tasks, "prompt") if tasks else rows).mapInArrow(run, ANSWERS)


def stored_answers(spark, answers_dir: str, model: str) -> DataFrame | None:
    """One row per prompt that a model was asked: the label, or the last error.  A table that is there
    and cannot be read fails the job."""
    if not path_exists(spark, answers_dir):
        return None
    rows = spark.read.parquet(answers_dir).filter(F.col("model") == model)
    best = F.max_by(F.struct("label", "error", "attempts"), F.struct(F.col("label").isNotNull(), "run", "label"))
    return rows.groupBy("prompt").agg(best.alias("a")).select("prompt", "a.*")


def label_mail(
    candidates: DataFrame, labeler_factory: Callable[[], Labeler], model: str, answers_dir: str, **options
) -> tuple[DataFrame, DataFrame]:
    """Labels and quarantine of candidate mail (see ``joins.label_candidates``).

    Returns (message_id, label) and (message_id, prompt, error, attempts); together they hold each
    candidate row once.  An empty table gives two empty results.  ``options`` are those of
    ``answer_prompts``.  ``answers_dir`` is a folder that all executors share."""
    spark = candidates.sparkSession
    mail = label_prompts(candidates).select("message_id", prompt_text().alias("prompt"))
    before = stored_answers(spark, answers_dir, model)
    asked = mail.select("prompt").distinct()
    last = 0
    if before is not None:
        asked = asked.join(before.filter("label is not null").select("prompt"), "prompt", "left_anti")
        last = spark.read.parquet(answers_dir).agg(F.max("run")).first()[0] or 0
    label = F.nullif(C.normalize_semantic_label("answer"), F.lit(""))
    new = answer_prompts(asked, labeler_factory, **options).select(
        F.lit(model).alias("model"), F.lit(last + 1).cast("long").alias("run"), "prompt", "answer", label.alias("label"),
        F.when(F.col("error").isNotNull(), F.col("error")).when(label.isNull(), F.lit("no label")).alias("error"), "attempts",
    )
    new.write.mode("append").parquet(answers_dir)
    out = mail.join(stored_answers(spark, answers_dir, model), "prompt", "left")
    labelled = out.filter("label is not null").select("message_id", "label")
    return labelled, out.filter("label is null").select("message_id", "prompt", "error", "attempts")
