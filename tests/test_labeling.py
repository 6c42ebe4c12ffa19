"""A labeller's run: batches, retries, quarantine, stored answers, equal prompts."""

import uuid

import pytest
from pyspark.sql import functions as F

from sortbox.operators import labeling as LA
from sortbox.session import scratch_path

MAIL = "message_id string, from_name string, from_address string, subject string, snippet string, label string, answer string"


def mail(spark, rows):
    return spark.createDataFrame([(i, n, a, s, p, "x", "y") for i, n, a, s, p in rows], MAIL)


def fresh(spark):
    return scratch_path(spark, f"answers-{uuid.uuid4().hex}")


def counting_labeler(calls, bad="bad"):
    """Answers with the subject; writes a line per call; fails where ``bad`` is in a prompt."""

    def factory():
        def answer(prompts):
            with open(calls, "a") as f:
                f.write(f"{len(prompts)}\n")
            if any(bad in p for p in prompts):
                raise RuntimeError("refused")
            return [p.split("\n")[1].removeprefix("Subject: ") if "silent" not in p else None for p in prompts]

        return answer

    return factory


ROWS = [
    ("a", "Ann", "ann@x.org", "weekly_digest", "hello"),
    ("b", None, "bob@x.org", "'order shipped'", "two\n\nlines\tof text"),
    ("c", "", "bob@x.org", "bad mail", "x"),
    ("d", None, "bob@x.org", None, None),
    ("e", None, None, "silent", ""),
    ("f", "Ann", "ann@x.org", "weekly_digest", "hello"),
    ("f", "Ann", "ann@x.org", "weekly_digest", "hello"),
    ("g", "Ann", "ann@x.org", '""', "hello"),
]


def test_labels_and_quarantine(spark, tmp_path):
    labels, quarantine = LA.label_mail(mail(spark, ROWS), counting_labeler(tmp_path / "calls"), "m", fresh(spark), batch_size=3, retries=1, wait=0.0)
    assert sorted(tuple(r) for r in labels.collect()) == [
        ("a", "Weekly-Digest"), ("b", "Order shipped"), ("d", "(no subject)"), ("f", "Weekly-Digest"), ("f", "Weekly-Digest"),
    ]
    bad = {r.message_id: r for r in quarantine.collect()}
    assert {k: v.error for k, v in bad.items()} == {"c": "RuntimeError: refused", "e": "no answer", "g": "no label"}
    assert bad["c"].attempts >= 2


def test_a_second_run_asks_only_for_what_has_no_label(spark, tmp_path):
    rows, table = mail(spark, ROWS), fresh(spark)
    LA.label_mail(rows, counting_labeler(tmp_path / "one"), "m", table, batch_size=100, retries=0, wait=0.0, tasks=1)
    # one call for the batch, then each of the six distinct prompts by itself
    assert (tmp_path / "one").read_text().split() == ["6"] + ["1"] * 6
    labels, quarantine = LA.label_mail(rows, counting_labeler(tmp_path / "two", bad="never"), "m", table, tasks=1)
    assert (tmp_path / "two").read_text().split() == ["3"]  # bad mail, silent, no label
    assert {r.message_id: r.label for r in labels.collect()}["c"] == "Bad mail"
    assert sorted(r.message_id for r in quarantine.collect()) == ["e", "g"]
    LA.label_mail(rows, counting_labeler(tmp_path / "three"), "other", table, batch_size=100, retries=0, tasks=1)
    assert (tmp_path / "three").read_text().split()[0] == "6"  # answers belong to a model


def test_a_labeller_that_recovers_needs_no_single_calls():
    calls = []

    def flaky(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise TimeoutError("busy")
        return list(prompts)

    assert LA.answer_batch(flaky, ["p", "q"], 3, 0.0) == [("p", None, 3), ("q", None, 3)]
    assert calls == [2, 2, 2]


def test_answers_of_another_number_are_no_answers():
    assert LA.answer_batch(lambda p: ["only"] if len(p) > 1 else list(p), ["p", "q"], 0, 0.0) == [("p", None, 2), ("q", None, 2)]
    assert LA.answer_batch(lambda p: [], ["p"], 1, 0.0) == [(None, "0 answers to 1 prompts", 2)]


@pytest.mark.parametrize("again", [False, True])
def test_no_candidates(spark, tmp_path, again):
    table = fresh(spark)
    none = mail(spark, ROWS).filter(F.lit(False))
    for _ in range(1 + again):
        labels, quarantine = LA.label_mail(none, counting_labeler(tmp_path / "calls"), "m", table)
        assert labels.collect() == [] and quarantine.collect() == []
    assert not (tmp_path / "calls").exists()
