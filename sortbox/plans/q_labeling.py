"""Registered query: a labeller's run over the mail without a semantic label."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import oracles as O
from ..operators import joins as J
from ..operators import labeling as LA
from ..session import scratch_path
from ..sources import bridge as B
from .catalog import register
from .q_features import FEATURES_CTE, stored_features


def subject_labeler():
    """A stand-in labeller: the first two words of the subject, quoted and joined as an external
    labeller may do it.  It fails on mail without a subject and has no answer to a promotion."""

    def answer(prompts: list[str]) -> list[str | None]:
        subjects = [p.split("\n")[1].removeprefix("Subject: ") for p in prompts]
        if "(no subject)" in subjects:
            raise ValueError("no subject")
        return [None if "%" in s else '"' + "_".join(s.split(" ")[:2]) + '"' for s in subjects]

    return answer


@register(
    "label_mail",
    O.with_tables(
        r"""SELECT message_id, CASE WHEN contains(s, '%') OR s = '(no subject)' THEN NULL ELSE
         array_to_string(list_transform(string_split(replace(regexp_replace(array_to_string(string_split(s, ' ')[1:2], '_'),
           '^["'']+|["'']+$', '', 'g'), '_', '-'), '-'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '-') END AS label,
       CASE WHEN s = '(no subject)' THEN 'ValueError: no subject' WHEN contains(s, '%') THEN 'no answer' END AS error
FROM (SELECT message_id, trim(regexp_replace(coalesce(nullif(subject, ''), '(no subject)'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS s FROM emails
      WHERE message_id IN (SELECT message_id FROM email_features) AND message_id NOT IN (SELECT message_id FROM semantic_labels))""",
        "emails",
        "feature_embeddings",
        "semantic_labels",
        extra=[FEATURES_CTE],
    ),
)
def label_mail_q(spark, sf_dir):
    """Every candidate once, with its label or the reason it has none."""
    cand = J.label_candidates(B.emails(spark, sf_dir), stored_features(spark, sf_dir), B.semantic_labels(spark, sf_dir))
    answers = scratch_path(spark, f"label-answers-{uuid.uuid4().hex[:12]}")
    labels, quarantine = LA.label_mail(cand, subject_labeler, "stand-in", answers, retries=1, wait=0.0)
    missing = quarantine.select("message_id", F.lit(None).cast("string").alias("label"), "error")
    return labels.withColumn("error", F.lit(None).cast("string")).unionByName(missing)
