"""Feedback loop operators: review queue, feedback collection, corrections.

The application runs these as per-row loops with remote lookups; here each
is one DataFrame plan over the action log, the feedback table and the
current mailbox state (the ``emails`` table).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

from ..functions import columns as C

FALSE_POSITIVE_COMMENT = "User moved back to inbox after bot archived"


def _since(as_of: dt.datetime, days: int) -> Column:
    return ntz_lit(as_of - dt.timedelta(days=days))


def json_score(action_json: str | Column = "action_json") -> Column:
    """The action's score if it is a JSON number, else NULL (strings such as
    "0.4" or "invalid" are not numbers)."""
    j = C.col(action_json)
    v = F.try_parse_json(j)
    typ = F.schema_of_variant(F.try_variant_get(v, "$.score", "variant"))
    numeric = typ.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(numeric, F.try_variant_get(v, "$.score", "double"))


def pending_reviews(
    actions: DataFrame,
    feedback: DataFrame,
    as_of: dt.datetime,
    days: int = 7,
    kind: str = "all",
    low_confidence_filter: bool = False,
) -> DataFrame:
    """Bot actions since ``as_of - days`` whose mail has no feedback yet.

    ``kind``: all / archived / kept / low-confidence.  The application's
    low-confidence filter does nothing; ``low_confidence_filter=True``
    applies a real one (confidence = 'low').
    """
    a = actions.filter((F.col("source") == "bot") & (F.col("timestamp") >= _since(as_of, days)))
    a = a.join(feedback.select("message_id").distinct(), "message_id", "left_anti")
    if kind == "archived":
        a = a.filter(F.col("action_type") == "archive")
    elif kind == "kept":
        a = a.filter(F.col("action_type") == "keep")
    elif kind == "low-confidence" and low_confidence_filter:
        a = a.filter(F.col("action_data.confidence") == "low")
    return a


def review_queue(pending: DataFrame) -> DataFrame:
    """Most uncertain first: |score - 0.5| ascending; a missing or
    non-numeric score sorts last (key 999); action_id breaks ties."""
    key = F.coalesce(F.abs(json_score("action_json") - F.lit(0.5)), F.lit(999.0))
    return pending.withColumn("uncertainty", key).orderBy("uncertainty", "action_id")


def label_changed(original: Column, current_labels: Column) -> Column:
    """set(original) != set(current Bot/* labels); NULL original = empty."""
    o = F.array_sort(F.array_distinct(F.coalesce(original, F.array().cast("array<string>"))))
    c = F.array_sort(F.array_distinct(C.bot_labels(current_labels)))
    return o != c


def current_state_join(bot_actions: DataFrame, mailbox: DataFrame) -> DataFrame:
    """Each action with the mail's present state (``state_labels`` NULL and
    ``state_found`` false when the mail is not in the mailbox)."""
    st = mailbox.select("message_id", F.col("labels").alias("state_labels"), F.lit(True).alias("state_found"))
    return bot_actions.join(st, "message_id", "left").withColumn("state_found", F.coalesce("state_found", F.lit(False)))


def collect_feedback(
    actions: DataFrame, mailbox: DataFrame, as_of: dt.datetime, days: int = 1, dedup: bool = False, feedback: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (per-action outcome, new feedback rows, one-row stats).

    Running twice adds the feedback rows twice, as in the application;
    ``dedup`` adds one row per mail, and none for a mail whose ``feedback``
    already has such a row.

    A bot archive whose mail is back in the inbox is a false positive and
    yields a feedback row; a differing Bot/* label set is a label change.
    Actions whose mail is missing are counted as bot actions only.
    """
    bot = actions.filter((F.col("source") == "bot") & (F.col("timestamp") >= _since(as_of, days)))
    j = current_state_join(bot, mailbox)
    found = F.col("state_found")
    fp = found & (F.col("action_type") == "archive") & F.array_contains(F.col("state_labels"), "INBOX")
    lc = found & label_changed(F.col("action_data.labels"), F.col("state_labels"))
    outcome = j.select(
        "action_id", "message_id", "action_type", "state_found",
        F.coalesce(fp, F.lit(False)).alias("false_positive"),
        F.coalesce(lc, F.lit(False)).alias("label_change"),
    )
    new_feedback = outcome.filter("false_positive").select(
        "message_id",
        ntz_lit(as_of).alias("review_date"),
        F.lit(False).alias("decision_correct"),
        F.lit(None).cast("boolean").alias("label_correct"),
        F.lit("keep").alias("correct_decision"),
        F.lit(None).cast("string").alias("correct_label"),
        F.lit(FALSE_POSITIVE_COMMENT).alias("user_comment"),
        F.lit(False).alias("used_in_training"),
    )
    if dedup:
        new_feedback = new_feedback.dropDuplicates(["message_id"])
        if feedback is not None:
            known = feedback.filter(F.col("user_comment") == FALSE_POSITIVE_COMMENT).select("message_id")
            new_feedback = new_feedback.join(known, "message_id", "left_anti")
    stats = outcome.agg(
        F.count(F.lit(1)).alias("bot_actions"),
        F.count_if("false_positive").alias("false_positives"),
        F.count_if("label_change").alias("label_changes"),
        F.lit(0).cast("bigint").alias("verified_correct"),
    )
    return outcome, new_feedback, stats


def feedback_stats(actions: DataFrame, mailbox: DataFrame, as_of: dt.datetime, days: int = 1) -> DataFrame:
    return collect_feedback(actions, mailbox, as_of, days)[2]


def split_labels(correct_label: Column) -> Column:
    """'A, B' -> ['A', 'B'] (each part trimmed)."""
    return F.transform(F.split(correct_label, ","), lambda x: F.trim(x))


def label_delta(current_labels: Column, correct_label: Column) -> tuple[Column, Column]:
    """(remove, add): current Bot/* labels not in the correct list, and
    correct labels not currently present (order kept)."""
    bot = C.bot_labels(current_labels)
    correct = split_labels(correct_label)
    remove = F.filter(bot, lambda x: ~F.array_contains(correct, x))
    add = F.filter(correct, lambda x: ~F.array_contains(bot, x))
    return remove, add


def applied_corrections(feedback: DataFrame, actions: DataFrame) -> DataFrame:
    """Feedback rows for which a correction action at or after the review
    date already exists (semi join with a range residual)."""
    corr = actions.filter(F.col("source") == "correction").select(
        F.col("message_id").alias("_m"), F.col("timestamp").alias("_ts")
    )
    cond = (feedback["message_id"] == corr["_m"]) & (corr["_ts"] >= feedback["review_date"])
    return feedback.join(corr, cond, "left_semi")


def apply_corrections(
    feedback: DataFrame, mailbox: DataFrame, actions: DataFrame, as_of: dt.datetime, dry_run: bool = False
) -> dict[str, DataFrame]:
    """Plan the corrections of all feedback with a wrong decision or label.

    Rows are processed per mail in review order.  A row is already applied
    when a correction action at/after its review date exists, or when an
    earlier row of the same mail recorded a correction in this run (that
    action is stamped ``as_of``, later than every review date).  Only
    ``correct_decision = 'keep'`` moves mail back to the inbox.  A label
    fix teaches ``address -> first correct label`` (last fix wins).

    Returns ``plan`` (one row per correction), ``actions`` (new audit rows),
    ``mappings`` (learned address mappings) and ``stats`` (one row).
    """
    corr = feedback.filter((F.col("decision_correct") == F.lit(False)) | (F.col("label_correct") == F.lit(False)))
    mb = mailbox.select("message_id", "from_address", F.col("labels").alias("_labels"))
    j = corr.join(mb, "message_id", "inner")  # corrections for unknown mail are skipped
    pre = applied_corrections(j, actions).select("review_id", F.lit(True).alias("_pre"))
    j = j.join(pre, "review_id", "left").withColumn("_pre", F.coalesce("_pre", F.lit(False)))
    remove, add = label_delta(F.col("_labels"), F.col("correct_label"))
    has_label = C.blank_to_null("correct_label").isNotNull()
    j = (
        j.withColumn("remove", F.when(has_label, remove).otherwise(F.array().cast("array<string>")))
        .withColumn("add", F.when(has_label, add).otherwise(F.array().cast("array<string>")))
        .withColumn("move_to_inbox", F.coalesce(F.col("correct_decision") == "keep", F.lit(False)))
        .withColumn("fix_labels", has_label & ((F.size("remove") > 0) | (F.size("add") > 0)))
    )
    records = (F.col("move_to_inbox") | F.col("fix_labels")) & ~F.col("_pre")
    if dry_run:
        j = j.withColumn("already_applied", F.col("_pre"))
    else:
        # The first row of each mail that records an action blocks the later
        # ones.  A partial aggregate + join (not a window) so that a mail with
        # very many feedback rows is not sorted in one task.
        blocks = j.filter(records).groupBy("message_id").agg(F.min("review_id").alias("_block"))
        j = j.join(blocks, "message_id", "left").withColumn(
            "already_applied", F.col("_pre") | F.coalesce(F.col("review_id") > F.col("_block"), F.lit(False))
        )
    plan = j.select(
        "review_id", "message_id", "from_address", "already_applied",
        (F.col("move_to_inbox") & ~F.col("already_applied")).alias("moved_to_inbox"),
        (F.col("fix_labels") & ~F.col("already_applied")).alias("labels_fixed"),
        "remove", "add",
        F.when(has_label, F.element_at(split_labels(F.col("correct_label")), 1)).alias("primary_label"),
    )
    stamp = ntz_lit(as_of)
    moves = plan.filter("moved_to_inbox").select(
        "review_id", "message_id", F.lit("move_to_inbox").alias("action_type"),
        F.lit(None).cast("array<string>").alias("removed"), F.lit(None).cast("array<string>").alias("added"),
    )
    fixes = plan.filter("labels_fixed").select(
        "review_id", "message_id", F.lit("label_correction").alias("action_type"),
        F.col("remove").alias("removed"), F.col("add").alias("added"),
    )
    new_actions = moves.unionByName(fixes).select(
        "review_id", "message_id", "action_type", F.lit("correction").alias("source"), stamp.alias("timestamp"),
        F.struct(
            F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("confidence"),
            F.lit(None).cast("array<string>").alias("labels"), F.lit("feedback_correction").alias("reason"),
            F.col("removed").alias("removed"), F.col("added").alias("added"),
        ).alias("action_data"),
    )
    if dry_run:
        new_actions = new_actions.limit(0)
    learned = (
        plan.filter(F.col("labels_fixed"))
        .groupBy(F.col("from_address").alias("sender_address"))
        .agg(F.max_by("primary_label", "review_id").alias("label"))
    )
    if dry_run:
        learned = learned.limit(0)
    stats = plan.agg(
        F.count(F.lit(1)).alias("total_corrections"),
        F.count_if("moved_to_inbox").alias("moved_to_inbox"),
        F.count_if("labels_fixed").alias("labels_fixed"),
        F.count_if("already_applied").alias("already_applied"),
    )
    return {"plan": plan, "actions": new_actions, "mappings": learned, "stats": stats}


def review_summary(feedback: DataFrame) -> DataFrame:
    """reviewed, correct, corrected and their percentages.  A row with any
    flag FALSE is corrected; one with no FALSE and some TRUE is correct;
    comment-only rows are reviewed but neither."""
    dc, lc = F.col("decision_correct"), F.col("label_correct")
    corrected = (dc == F.lit(False)) | (lc == F.lit(False))
    correct = ~F.coalesce(corrected, F.lit(False)) & (F.coalesce(dc, F.lit(False)) | F.coalesce(lc, F.lit(False)))
    agg = feedback.agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count_if(correct).alias("correct"),
        F.count_if(F.coalesce(corrected, F.lit(False))).alias("corrected"),
    )
    return agg.select(
        "reviewed", "correct", "corrected",
        F.try_divide(F.col("correct") * 100.0, F.col("reviewed")).alias("correct_pct"),
        F.try_divide(F.col("corrected") * 100.0, F.col("reviewed")).alias("corrected_pct"),
    )


def undo_feedback(feedback: DataFrame, message_ids: DataFrame) -> DataFrame:
    """Delete every feedback row of the given mails."""
    return feedback.join(message_ids.select("message_id"), "message_id", "left_anti")
