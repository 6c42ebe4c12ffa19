"""Table maintenance operators: upserts, appends, deletes, references,
label dictionaries and mailbox label operations.

There is no MERGE without a table format, so every operator returns the new
table contents as a DataFrame; ``write_table`` writes it copy-on-write to a
new directory (the caller then points readers at it).  All keyed work is
a join or a partial aggregate on the key, never a driver loop.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ntz_lit

EMAIL_COLUMNS = [
    "message_id", "thread_id", "from_address", "from_name", "to_address", "subject", "date", "snippet",
    "body_plain", "body_html", "labels", "was_read", "was_archived", "is_important", "is_starred",
]


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a new version of a table (never in place)."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def _ts(value: dt.datetime) -> Column:
    return ntz_lit(value)


def latest_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key by ``order`` (partial aggregate: max_by of
    the whole row, so a hot key never sorts in one task)."""
    keys = [key] if isinstance(key, str) else key
    packed = df.select(*keys, F.struct(*[F.col(o) for o in order]).alias("_o"), F.struct(*df.columns).alias("_r"))
    return packed.groupBy(*keys).agg(F.max_by("_r", "_o").alias("_r")).select("_r.*")


def latest_mail(incoming: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per message_id.  A re-delivered message is stored once: the
    row with the highest ``seq`` (order of delivery) wins; without ``seq``
    the latest date, then a hash of the row, so that the choice does not
    depend on how the rows are partitioned."""
    if seq:
        return latest_per_key(incoming, "message_id", [seq])
    keyed = incoming.withColumn("_row", F.xxhash64(*incoming.columns))
    return latest_per_key(keyed, "message_id", ["date", "_row"] if "date" in incoming.columns else ["_row"]).drop("_row")


def upsert_emails(existing: DataFrame, incoming: DataFrame, now: dt.datetime, seq: str | None = None) -> DataFrame:
    """Insert or fully overwrite mail by message_id.  On update the stored
    ``collected_at`` and ``opened_at`` are kept; on insert ``collected_at``
    = ``now`` and ``opened_at`` is NULL.  Repeated ids in ``incoming`` are
    stored once (see ``latest_mail``)."""
    inc = latest_mail(incoming.select(*EMAIL_COLUMNS, *([seq] if seq else [])), seq).select(*EMAIL_COLUMNS)
    old = existing.select("message_id", F.col("collected_at").alias("_c"), F.col("opened_at").alias("_o"))
    upd = inc.join(old, "message_id", "left").select(
        *EMAIL_COLUMNS,
        F.col("_o").alias("opened_at"),
        F.coalesce(F.col("_c"), _ts(now)).alias("collected_at"),
    )
    kept = existing.join(inc.select("message_id"), "message_id", "left_anti").select(*EMAIL_COLUMNS, "opened_at", "collected_at")
    return kept.unionByName(upd)


def row_id(*values: Column) -> Column:
    """Positive id derived from the row's own values: the same on every
    evaluation of the plan, also when a task runs again."""
    return F.xxhash64(*values).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))


def _appended(table: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``new`` with the columns of ``table``: supplied values (NULL counts as
    not supplied), else the column's default, else NULL."""
    given = dict(new.dtypes)
    cols = []
    for field in table.schema.fields:
        default = defaults.get(field.name, F.lit(None)).cast(field.dataType)
        value = F.coalesce(F.col(field.name).cast(field.dataType), default) if field.name in given else default
        cols.append(value.alias(field.name))
    return table.unionByName(new.select(*cols))


def append_action(actions: DataFrame, new: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """Append audit rows, keeping every column of the log.  ``source``
    defaults to 'user', ``timestamp`` to ``now`` (then required),
    ``action_data`` to an empty record and ``action_id`` to an id derived
    from the row."""
    if "timestamp" not in new.columns and now is None:
        raise ValueError("actions without a timestamp need now")
    stamp = F.col("timestamp") if "timestamp" in new.columns else _ts(now)
    source = F.coalesce(F.col("source"), F.lit("user")) if "source" in new.columns else F.lit("user")
    defaults = {"source": F.lit("user"), "timestamp": stamp if now is None else _ts(now)}
    defaults["action_id"] = row_id(F.col("message_id"), F.col("action_type"), source, stamp)
    data = dict((f.name, f.dataType) for f in actions.schema.fields).get("action_data")
    if isinstance(data, T.StructType):
        defaults["action_data"] = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in data.fields])
    if "action_json" in actions.columns:
        defaults["action_json"] = F.to_json("action_data") if "action_data" in new.columns else F.lit("{}")
    return _appended(actions, new, defaults)


def append_feedback(feedback: DataFrame, new: DataFrame) -> DataFrame:
    """Append review rows, keeping every column (unsupplied flags NULL,
    used_in_training false, ``review_id`` derived from the row)."""
    defaults = {"review_id": row_id(F.col("message_id"), F.col("review_date"))}
    return _appended(feedback, new.drop("used_in_training"), defaults | {"used_in_training": F.lit(False)})


def upsert_sender_mapping(mappings: DataFrame, updates: DataFrame, source: str = "feedback") -> DataFrame:
    """Key = address when given, else (domain, address IS NULL); the label
    and source of an existing key are replaced, later updates win.  An
    update with neither address nor domain fails the job."""
    upd = updates.select(
        F.when(
            F.col("sender_address").isNull() & F.col("sender_domain").isNull(),
            F.raise_error(F.lit("Must provide sender_address or sender_domain")),
        ).otherwise(F.coalesce(F.col("sender_address"), F.concat(F.lit("@"), F.col("sender_domain")))).alias("_key"),
        F.col("sender_address"),
        F.when(F.col("sender_address").isNull(), F.col("sender_domain")).alias("sender_domain"),
        "label",
        F.lit(source).alias("source"),
        F.col("seq"),
    )
    upd = latest_per_key(upd, "_key", ["seq"]).drop("seq")
    old = mappings.withColumn(
        "_key",
        F.when(F.col("sender_address").isNotNull(), F.col("sender_address")).otherwise(F.concat(F.lit("@"), F.col("sender_domain"))),
    )
    kept = old.join(upd.select("_key"), "_key", "left_anti")
    changed = old.select("_key", "mapping_id", F.col("sender_domain").alias("_old_domain")).join(upd, "_key", "right")
    # New keys get an id derived from the key (stable when a task runs again).
    changed = changed.select(
        F.coalesce(F.col("mapping_id"), row_id(F.col("_key"))).alias("mapping_id"),
        "sender_address",
        F.coalesce(F.col("_old_domain"), F.col("sender_domain")).alias("sender_domain"),
        "label",
        "source",
    )
    return kept.select("mapping_id", "sender_address", "sender_domain", "label", "source").unionByName(changed)


def upsert_features(
    features: DataFrame, updates: DataFrame, supplied: list[str], known: list[str], now: dt.datetime
) -> DataFrame:
    """Insert or update feature rows by message_id.  An update touches only
    the supplied columns that the table knows (an explicit NULL overwrites);
    ``computed_at`` is refreshed on every touched row.  Repeated ids in
    ``updates`` count once (see ``latest_mail``).

    Untouched rows pass an anti join and a union; only touched rows are
    joined with their update, so embeddings of the rest are not sorted for
    an outer join."""
    cols = [c for c in known if c != "message_id"]
    use = [c for c in supplied if c in cols]
    u = latest_mail(updates.select("message_id", *use))
    kept = features.select("message_id", *cols).join(u.select("message_id"), "message_id", "left_anti")
    old = features.select("message_id", *[F.col(c).alias(f"_o_{c}") for c in cols if c not in use and c != "computed_at"])
    out = []
    for c in cols:
        kind = features.schema[c].dataType
        value = _ts(now) if c == "computed_at" else F.col(c) if c in use else F.col(f"_o_{c}")
        out.append(value.cast(kind).alias(c))
    return kept.unionByName(u.join(old, "message_id", "left").select("message_id", *out))


def delete_features(features: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, per requested id whether it was found)."""
    req = ids.select("message_id").distinct()
    found = req.join(features.select("message_id", F.lit(True).alias("found")), "message_id", "left").select(
        "message_id", F.coalesce("found", F.lit(False)).alias("found")
    )
    return features.join(req, "message_id", "left_anti"), found


def append_semantic_labels(labels: DataFrame, new: DataFrame, model: str, source: str = "llm") -> DataFrame:
    """Append labels, keeping every column of the table (``semantic_id``
    derived from the row, ``confidence`` NULL unless supplied)."""
    new = new.drop("source", "model")
    defaults = {"source": F.lit(source), "model": F.lit(model)}
    return _appended(labels, new, defaults | {"semantic_id": row_id(F.col("message_id"), F.col("label"), F.lit(source), F.lit(model))})


CHILD_TABLES = ["email_labels", "email_actions", "feedback_reviews", "semantic_labels", "email_features"]


def check_references(emails: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Orphan count per child table (rows whose message_id has no mail)."""
    ids = emails.select("message_id")
    parts = [
        df.join(ids, "message_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("table"), "orphans")
        for name, df in children.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cascade_delete(children: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Children of deleted mail removed (anti join per child table)."""
    d = deleted.select("message_id")
    return {name: df.join(d, "message_id", "left_anti") for name, df in children.items()}


def email_labels(emails: DataFrame) -> DataFrame:
    """The mail-label relation (one row per label of a mail)."""
    return emails.select("message_id", F.explode("labels").alias("label_name"))


NAME_RANGES = 256


def label_dictionary(existing: DataFrame, emails: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Get-or-create name -> id for every label in use.  Missing names get
    ids after the current maximum, in name order.  Names are numbered within
    ranges of names; the ranges' bounds are at most ``NAME_RANGES`` of the new
    names, drawn by a hash, so that names with a common beginning are many
    ranges too.  Offsets come from a table with one row per range (and ``by``
    group)."""
    keys = by or []
    used = emails.select(*keys, F.explode("labels").alias("name")).distinct()
    new = used.join(existing.select(*keys, "name"), keys + ["name"], "left_anti")
    mx = existing.groupBy(*keys).agg(F.max("label_id").alias("_mx")) if keys else None
    drawn = new.select("name").distinct().orderBy(F.xxhash64("name"), "name").limit(NAME_RANGES)
    bounds = drawn.agg(F.array_sort(F.collect_list("name"))).scalar()
    # Subqueries may not sit inside a lambda: the bounds are a column first.
    new = new.withColumn("_bounds", bounds)
    new = new.withColumn("_b", F.size(F.filter("_bounds", lambda x: x <= F.col("name")))).drop("_bounds")
    per = new.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(*keys, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    new = new.join(starts, keys + ["_b"])
    place = F.col("_start") + F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("name"))
    if keys:
        new = new.join(mx, keys, "left").withColumn("_mx", F.coalesce("_mx", F.lit(0)))
        base = F.col("_mx")
    else:
        base = existing.select(F.coalesce(F.max("label_id"), F.lit(0))).scalar()
    new = new.select(*keys, "name", (base + place).cast("bigint").alias("label_id"))
    return existing.select(*keys, "name", F.col("label_id").cast("bigint")).unionByName(new)


# Label operations of the mailbox: each op adds or removes labels.
OP_EFFECT = {
    "archive": ("remove", ["INBOX"]),
    "move_to_inbox": ("add", ["INBOX"]),
    "mark_read": ("remove", ["UNREAD"]),
    "mark_unread": ("add", ["UNREAD"]),
}


def label_effects(ops: DataFrame) -> DataFrame:
    """(message_id, seq, kind, label): what each operation does to a label.
    ``init`` states the labels a mail starts with and, under a NULL label,
    that the mail is there."""
    kind = (
        F.when(F.col("op").isin("archive", "mark_read", "remove_labels"), F.lit("remove"))
        .when(F.col("op").isin("init", "move_to_inbox", "mark_unread", "add_labels"), F.lit("add"))
    )
    given = F.coalesce(F.col("labels"), F.array().cast("array<string>"))
    touched = (
        F.when(F.col("op").isin("archive", "move_to_inbox"), F.array(F.lit("INBOX")))
        .when(F.col("op").isin("mark_read", "mark_unread"), F.array(F.lit("UNREAD")))
        .when(F.col("op") == "init", F.concat(given, F.array(F.lit(None).cast("string"))))
        .otherwise(given)
    )
    return ops.select("message_id", "seq", kind.alias("kind"), F.explode(touched).alias("label")).filter(F.col("kind").isNotNull())


def labels_of_states(states: DataFrame) -> DataFrame:
    """message_id, labels (sorted), was_read, was_archived from the last
    state of each (message_id, label): columns ``kind`` and ``label``."""
    on = F.when((F.col("kind") == "add") & F.col("label").isNotNull(), F.col("label"))
    out = states.groupBy("message_id").agg(F.array_sort(F.collect_set(on)).alias("labels"))
    return out.select(
        "message_id",
        "labels",
        (~F.array_contains("labels", "UNREAD")).alias("was_read"),
        (~F.array_contains("labels", "INBOX")).alias("was_archived"),
    )


def apply_label_ops(emails: DataFrame, ops: DataFrame) -> DataFrame:
    """Fold label operations into the current labels.

    ``ops``: message_id, seq (orderable), op in archive / move_to_inbox /
    mark_read / mark_unread / add_labels / remove_labels, labels (for the
    last two).  The final state of each (mail, label) pair is decided by the
    last op touching it, so the fold is a partial ``max_by`` aggregate per
    pair instead of an ordered per-mail loop.  Returns message_id, labels
    (sorted), was_read, was_archived.
    """
    effects = label_effects(ops).filter(F.col("label").isNotNull())
    last = effects.groupBy("message_id", "label").agg(F.max_by("kind", "seq").alias("kind"))
    current = emails.select("message_id", F.explode("labels").alias("label")).distinct()
    final = (
        current.join(last, ["message_id", "label"], "full")
        .filter(F.col("kind").isNull() | (F.col("kind") == "add"))
        .groupBy("message_id")
        .agg(F.array_sort(F.collect_list("label")).alias("labels"))
    )
    out = emails.select("message_id").join(final, "message_id", "left").select(
        "message_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels")
    )
    return out.select(
        "message_id",
        "labels",
        (~F.array_contains("labels", "UNREAD")).alias("was_read"),
        (~F.array_contains("labels", "INBOX")).alias("was_archived"),
    )
