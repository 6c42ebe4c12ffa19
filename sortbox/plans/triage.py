"""The triage job: incoming mail -> stored mail and features -> score ->
decision -> labels -> bot actions and a summary row.

History visibility follows the application's one-session-per-message run:
mail is processed newest first; a *new* mail does not count itself, sees
the committed history plus every mail processed earlier in the run; a
re-triaged (already stored) mail counts itself with its new values.  The
counts are running sums over (sender, time bucket) scans, so a hot sender
never lands in one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ntz_lit

from ..functions import columns as C
from ..operators import decisions as D
from ..operators import features as FE
from ..operators import history as H
from ..operators import labels as LB
from ..operators import store as ST
from ..session import ensure_checkpoint_dir

BUCKET_SECONDS = 3600  # hour buckets: a hot sender spreads over many (sender, hour) tasks


def _visible_counts(events: DataFrame, base: DataFrame, key: str, bucket_seconds: int) -> DataFrame:
    """Running (count, read) of ``events`` per key in processing order at
    each probe row, plus the committed base totals of the key."""
    ev = events.withColumn("_bucket", H.time_bucket(F.col("date"), bucket_seconds))
    order = [F.col("date").desc(), F.col("message_id").asc(), F.col("phase").asc()]
    run = H.keyed_running_sum(ev, ["_key"], "_bucket", order, ["dn", "dr"], bucket_desc=True)
    probes = run.filter("is_probe").join(base, "_key", "left")
    return probes.select(
        "message_id",
        (F.coalesce(F.col("base_n"), F.lit(0)) + F.col("run_dn")).alias("n"),
        (F.coalesce(F.col("base_r"), F.lit(0)) + F.col("run_dr")).alias("r"),
    )


def sequential_history(
    committed: DataFrame, incoming: DataFrame, bucket_seconds: int = BUCKET_SECONDS, by: list[str] | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """History features of ``incoming`` as the sequential run sees them.

    Returns (``by`` columns,) message_id, sender_email_count,
    sender_open_rate, sender_days_since_last, domain_open_rate.  With
    ``by`` (e.g. a mailbox id) every statistic is kept per mailbox.
    ``totals`` are the folded ``history_totals`` of ``committed`` with the
    same buckets and ``by``; committed mail is then not aggregated: it is
    joined by id, and sorted for the hours that incoming mail is from.
    """
    keys = by or []

    def scoped(c: Column) -> Column:
        return F.to_json(F.struct(*[F.col(k) for k in keys], c.alias("k"))) if keys else c

    pid = F.to_json(F.struct(*keys, "message_id")) if keys else F.col("message_id")
    inc = incoming.select(*keys, "message_id", "from_address", "date", F.col("was_read").cast("int").alias("rd"))
    old = committed.select(
        *keys, "message_id", F.col("from_address").alias("o_from"), F.col("was_read").cast("int").alias("o_rd")
    )
    x = inc.join(old, keys + ["message_id"], "left").withColumn("existed", F.col("o_from").isNotNull()).withColumn("_pid", pid)

    def events(key_new: Column, key_old: Column, keep_new: Column, keep_old: Column) -> DataFrame:
        e3 = x.filter(keep_new).select(
            key_new.alias("_key"), F.col("_pid").alias("message_id"), "date",
            F.when(F.col("existed"), F.lit(0)).otherwise(F.lit(2)).alias("phase"),
            F.lit(1).alias("dn"), F.col("rd").alias("dr"), F.lit(False).alias("is_probe"),
        )
        e2 = x.filter(F.col("existed") & keep_old).select(
            key_old.alias("_key"), F.col("_pid").alias("message_id"), "date", F.lit(0).alias("phase"),
            F.lit(-1).alias("dn"), (-F.col("o_rd")).alias("dr"), F.lit(False).alias("is_probe"),
        )
        return e3.unionByName(e2)

    def probes(key: Column) -> DataFrame:
        return x.select(
            key.alias("_key"), F.col("_pid").alias("message_id"), "date", F.lit(1).alias("phase"),
            F.lit(0).alias("dn"), F.lit(0).alias("dr"), F.lit(True).alias("is_probe"),
        )

    def base(kind: str) -> DataFrame:
        return totals.filter(F.col("kind") == kind).select(F.col("key").alias("_key"), F.col("n").alias("base_n"), F.col("r").alias("base_r"))

    # sender counts
    s_events = events(scoped(F.col("from_address")), scoped(F.col("o_from")), F.lit(True), F.lit(True))
    s_base = base("sender") if totals is not None else committed.groupBy(scoped(F.col("from_address")).alias("_key")).agg(
        F.count(F.lit(1)).alias("base_n"), F.count_if("was_read").alias("base_r")
    )
    s = _visible_counts(s_events.unionByName(probes(scoped(F.col("from_address")))), s_base, "_key", bucket_seconds)

    # domain counts ('@domain' suffix match, ASCII case-insensitive)
    dom_new = scoped(F.lower(F.substring_index("from_address", "@", -1)))
    dom_old = scoped(F.lower(F.substring_index("o_from", "@", -1)))
    d_events = events(dom_new, dom_old, F.col("from_address").contains("@"), F.col("o_from").contains("@"))
    d_base = base("domain") if totals is not None else (
        committed.filter(F.col("from_address").contains("@"))
        .groupBy(scoped(F.lower(F.substring_index("from_address", "@", -1))).alias("_key"))
        .agg(F.count(F.lit(1)).alias("base_n"), F.count_if("was_read").alias("base_r"))
    )
    d_probes = probes(scoped(C.sender_domain("from_address")))
    d = _visible_counts(d_events.unionByName(d_probes), d_base, "_key", bucket_seconds).select(
        "message_id", F.col("n").alias("dn_"), F.col("r").alias("dr_")
    )

    sk = scoped(F.col("from_address"))
    near, latest = committed, None
    if totals is not None:
        latest = totals.filter(F.col("kind") == "last").withColumnRenamed("key", "_sk")
        # One row: the time that the incoming mail spans, rounded outwards to whole buckets.
        span = incoming.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
            *[F.timestamp_add("SECOND", F.lit(bucket_seconds) * (H.time_bucket(F.col(c), bucket_seconds) + k), ntz_lit(H.EPOCH)) for c, k in (("a", 0), ("b", 1))]
        ).first()
        if span[0] is not None:
            near = committed.filter((F.col("date") >= F.lit(span[0]).cast("timestamp_ntz")) & (F.col("date") < F.lit(span[1]).cast("timestamp_ntz")))
    prev = H.asof_max_before(
        near.withColumn("_sk", sk), incoming.withColumn("_sk", sk).withColumn("_pid", pid), "_sk", "date", "_pid",
        bucket_seconds, latest,
    ).withColumnRenamed("_pid", "message_id")
    out = (
        x.select(*keys, "message_id", "date", F.col("_pid"))
        .join(s.withColumnRenamed("message_id", "_pid"), "_pid")
        .join(d.withColumnRenamed("message_id", "_pid"), "_pid")
        .join(prev.withColumnRenamed("message_id", "_pid"), "_pid", "left")
    )
    return out.select(
        *keys,
        "message_id",
        F.col("n").cast("bigint").alias("sender_email_count"),
        F.when(F.col("n") > 0, F.col("r") / F.col("n")).otherwise(F.lit(0.0)).alias("sender_open_rate"),
        C.days_between(F.col("date"), F.col("prev_ts")).alias("sender_days_since_last"),
        F.when(F.col("dn_") > 0, F.col("dr_") / F.col("dn_")).otherwise(F.lit(0.0)).alias("domain_open_rate"),
    )


def triage(
    committed: DataFrame,
    incoming: DataFrame,
    feature_store: DataFrame,
    mappings: DataFrame,
    scorer: Callable[[DataFrame], Column | DataFrame],
    as_of: dt.datetime,
    embeddings: DataFrame | None = None,
    semantic: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    keep_threshold: float = D.HIGH_CONFIDENCE_KEEP,
    archive_threshold: float = D.HIGH_CONFIDENCE_ARCHIVE,
    dry_run: bool = False,
    failed: DataFrame | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
    materialize: bool = True,
    totals: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Run the triage job.  ``scorer`` maps the feature DataFrame to a score
    Column (a fixed expression) or to a DataFrame (message_id, score), as
    ``ml.model_scorer`` of a fitted model does.  ``semantic`` maps the
    features to (message_id, sem_label, sem_confidence), or is that table.
    ``failed`` holds the messages that could not be read (the quarantine of
    ``normalize_messages``); the summary counts them as errors.  ``totals``
    (``history_totals``, kept by the caller) spares aggregating stored mail.

    Returns ``decisions``, ``actions`` (empty on dry runs), ``summary``,
    ``emails`` (mail table after the upsert) and ``features`` (feature
    table after the upsert).  Mail and features are saved on dry runs too.
    """
    # The incoming batch feeds a dozen branches (events, probes, features,
    # labels, upserts): cut its lineage once (reliable checkpoint in the
    # cluster's spark.checkpoint.dir) so the raw parse runs once.
    # A re-delivered message is one mail: repeated ids would multiply at
    # every later join on message_id.
    incoming = ST.latest_mail(incoming)
    if materialize:
        ensure_checkpoint_dir(incoming.sparkSession)
        incoming = incoming.checkpoint(eager=True)
    hist = sequential_history(committed, incoming, bucket_seconds, totals=totals)
    meta = FE.metadata_features(incoming)
    feats = meta.join(hist, "message_id")
    if embeddings is not None:
        feats = feats.join(embeddings.select("message_id", "subject_embedding", "body_embedding"), "message_id", "left")
    else:
        feats = feats.withColumn("subject_embedding", F.lit(None).cast("array<double>")).withColumn(
            "body_embedding", F.lit(None).cast("array<double>")
        )
    if materialize:
        feats = feats.checkpoint(eager=True)
    score = scorer(feats)
    scored = feats.join(score.select("message_id", "score"), "message_id") if isinstance(score, DataFrame) else feats.withColumn("score", score)
    if callable(semantic):
        semantic = semantic(feats)
    decided = D.decide(scored, "score", keep_threshold, archive_threshold)
    centroids = LB.label_centroids(committed, feature_store, mappings)
    sugg = LB.generate_labels(
        incoming, feats, mappings, centroids=centroids, semantic=semantic,
        sender_counts=feats.select("message_id", F.col("sender_email_count").alias("sender_count")),
    )
    dec = decided.join(sugg, "message_id").select(
        "message_id", "score", "action", "confidence",
        LB.primary_label(F.col("suggestions")).alias("category"),
        LB.triage_labels(F.col("suggestions"), F.col("action"), F.col("confidence")).alias("labels"),
        D.reasoning(F.col("score"), F.col("action"), F.col("confidence")).alias("reasoning"),
    )
    actions = dec.select(
        "message_id",
        F.col("action").alias("action_type"),
        F.lit("bot").alias("source"),
        ntz_lit(as_of).alias("timestamp"),
        F.struct(
            F.col("score").alias("score"), F.col("confidence").alias("confidence"), F.col("labels").alias("labels"),
            F.lit(None).cast("string").alias("reason"), F.lit(None).cast("array<string>").alias("removed"),
            F.lit(None).cast("array<string>").alias("added"),
        ).alias("action_data"),
    )
    if dry_run:
        actions = actions.limit(0)
    emails_out = ST.upsert_emails(committed, incoming, as_of)
    feature_cols = [c for c in feature_store.columns]
    features_out = ST.upsert_features(feature_store, feats, [c for c in feats.columns if c != "message_id"], feature_cols, as_of)
    return {
        "features": feats,
        "decisions": dec,
        "actions": actions,
        "summary": D.triage_summary(dec, failed),
        "emails": emails_out,
        "feature_table": features_out,
    }
