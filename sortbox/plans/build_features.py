"""The feature build job: mail without features (or without embeddings)
-> metadata + snapshot history (+ embeddings) -> feature table.

One job over the whole backlog; the application's 100-id batches and
per-batch error isolation become Spark tasks and task retries.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

from ..operators import features as FE
from ..operators import joins as J
from ..operators import store as ST

FEATURE_COLUMNS = [
    "message_id", *FE.METADATA_FEATURES, *FE.HISTORICAL_FEATURES, "subject_embedding", "body_embedding", "computed_at",
]


def build_features(
    emails: DataFrame,
    feature_store: DataFrame,
    now: dt.datetime,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    skip_embeddings: bool = False,
    embeddings_only: bool = False,
    limit: int | None = None,
) -> dict[str, DataFrame]:
    """Returns ``new`` (feature rows computed in this run) and ``table``
    (the feature table after the upsert).

    ``embed`` maps (message_id, subject, body_plain, snippet) to
    (message_id, subject_embedding, body_embedding); see ``ml.embed_text``.
    History features are snapshot features over the whole mail table.
    """
    if embeddings_only:
        todo = J.features_missing_embeddings(feature_store, limit).select("message_id")
        if embed is None:
            raise ValueError("embeddings_only needs an encoder")
        src = emails.join(todo, "message_id", "left_semi")
        emb = embed(src.select("message_id", "subject", "body_plain", "snippet"))
        table = ST.upsert_features(feature_store, emb, ["subject_embedding", "body_embedding"], FEATURE_COLUMNS, now)
        return {"new": emb, "table": table}
    todo = J.emails_without_features(emails, feature_store, limit, ordered=False)
    hist = FE.historical_features(emails, targets=todo.select("message_id", "from_address", "date"))
    meta = FE.metadata_features(todo)
    new = meta.join(hist, "message_id")
    if embed is not None and not skip_embeddings:
        new = new.join(embed(todo.select("message_id", "subject", "body_plain", "snippet")), "message_id", "left")
    else:
        new = new.withColumn("subject_embedding", F.lit(None).cast("array<double>")).withColumn(
            "body_embedding", F.lit(None).cast("array<double>")
        )
    new = new.withColumn("computed_at", ntz_lit(now))
    supplied = [c for c in new.columns if c not in ("message_id", "computed_at")]
    table = ST.upsert_features(feature_store.select(*FEATURE_COLUMNS), new, supplied, FEATURE_COLUMNS, now)
    return {"new": new, "table": table}
