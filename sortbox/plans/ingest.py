"""Ingest jobs: select raw messages, normalise, upsert into the mail table.

Failures are isolated per row (quarantine) for the history job; the
recent job runs without isolation, so one bad row fails it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

from ..operators import store as ST
from ..sources import messages as MS


def _summary(selected: DataFrame, saved: DataFrame, failed: DataFrame) -> DataFrame:
    n_sel = selected.select(F.count(F.lit(1))).scalar()
    n_bad = failed.select(F.count(F.lit(1))).scalar()
    return saved.agg(F.count(F.lit(1)).alias("saved")).select(
        n_sel.alias("selected"),
        "saved",
        n_bad.alias("failed"),
        F.when(n_sel > 0, F.col("saved") * 100.0 / n_sel).otherwise(F.lit(0.0)).alias("success_rate"),
    )


def ingest_history(
    raw: DataFrame, existing: DataFrame, as_of: dt.datetime, months: int = 6, max_emails: int | None = None
) -> dict[str, DataFrame]:
    """Mail of the last ``months`` x 30 days: selected, normalised (bad rows
    quarantined), upserted.  Returns table, quarantine and summary."""
    start = (as_of - dt.timedelta(days=months * 30)).date()
    sel = MS.select_messages(raw, after=start, max_total=max_emails)
    good, bad = MS.normalize_messages(sel, ntz_lit(as_of))
    table = ST.upsert_emails(existing, good, as_of)
    return {"table": table, "quarantine": bad, "summary": _summary(sel, good, bad)}


def ingest_recent(raw: DataFrame, existing: DataFrame, as_of: dt.datetime, days: int = 1) -> dict[str, DataFrame]:
    """Mail of the last ``days`` days without failure isolation."""
    start = (as_of - dt.timedelta(days=days)).date()
    sel = MS.select_messages(raw, after=start)
    good, bad = MS.normalize_messages(sel, ntz_lit(as_of))
    # No isolation: any unparseable message fails the job.  The check is a
    # filter predicate (never pruned, unlike a projected column); the
    # bad-row count is one scalar subquery.
    n_bad = bad.select(F.count(F.lit(1))).scalar()
    checked = good.filter(
        F.when(n_bad > 0, F.raise_error(F.lit("unparseable message in recent export")).isNull()).otherwise(F.lit(True))
    )
    table = ST.upsert_emails(existing, checked, as_of)
    return {"table": table, "summary": _summary(sel, checked, bad)}


def refresh_messages(raw: DataFrame, existing: DataFrame, ids: DataFrame, as_of: dt.datetime) -> dict[str, DataFrame]:
    """Re-read the given mails from the raw snapshot and upsert them."""
    v = F.try_parse_json(F.col("json"))
    keyed = raw.withColumn("message_id", F.try_variant_get(v, "$.id", "string"))
    sel = keyed.join(ids.select("message_id").distinct(), "message_id", "left_semi").drop("message_id")
    good, bad = MS.normalize_messages(sel, ntz_lit(as_of))
    table = ST.upsert_emails(existing, good, as_of)
    return {"table": table, "updated": good.agg(F.count(F.lit(1)).alias("updated")), "quarantine": bad}
