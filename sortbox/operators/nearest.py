"""Nearest label of a mail among any number of labels: inverted lists with exact pruning.

Vectors are compared as unit vectors, where the cosine falls as the chord between them grows.  Some
labels, about the square root of their number and at most ``PIVOTS``, chosen by a hash, are pivots;
every label is in the list of its nearest pivot, and a list knows the least and the largest chord
between its labels and its pivot.  By the triangle inequality no label of a list is nearer to a mail
than ``max(chord - largest, least - chord)``, ``chord`` being that of mail and pivot.  A mail goes to
the lists whose bound does not exceed the chord to its nearest pivot, which is a label itself, nor that of the threshold; no
other list can hold its label, so the result is that of comparing with all labels.

Where the bound rules out little, as with vectors in all directions, nearly all pairs are compared; their
number is quadratic, what is copied is not: lists are put together in blocks of about ``PART`` labels (a
list that is larger is cut into pieces), and a mail goes once to a block, with the lists it is compared
with there.  A task holds a piece of a block and a part of the mail, at most about ``HELD`` mails; neither
has more than about ``VALUES`` numbers.  So a vector is copied once for each block or part, of which there
are few.  Only vectors of the same length (and of the same ``by`` columns, a mailbox for example) are compared.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

PIVOTS = 1024
PART = 1 << 16  # labels of a block
MAIL = 8192  # mails or labels compared with the pivots by one task
HELD = 1 << 16  # mails of a part
VALUES = 1 << 22  # numbers of the vectors that a task holds of either side
SPREAD = 16  # parts that mail is dealt to at least, if they have MAIL / 2 mails or more
AT_ONCE = 1024  # mails compared with labels or pivots in one product
ACROSS = 4096  # labels in one product
PAIRS = 1 << 16  # pairs whose sums are taken again at once
SLACK = 1e-6  # chords of rounded cosines; a bound is only trusted beyond it


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"nearest/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _parts(rows: Column, size: int | Column) -> Column:
    return F.ceil(rows / size).cast("int")


def _room(size: int) -> Column:
    """Vectors that a task holds, ``size`` at most."""
    return F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(VALUES) / F.col("dim"))))


def _vectors(table: pa.Table) -> np.ndarray:
    """The vectors of a table, as unit vectors."""
    flat = np.asarray(pa.concat_arrays(table.column("v").chunks).flatten(), np.float64) if table.num_rows else np.empty(0)
    v = flat.reshape(table.num_rows, -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True) if len(v) else v


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def to_lists(labels: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each label with the list of its nearest pivot and the chord to it (list 0 without pivots)."""
    number, chord = np.zeros(labels.num_rows, np.int64), np.zeros(labels.num_rows)
    if labels.num_rows and pivots.num_rows:
        all_chords = _chords(_vectors(labels), _vectors(pivots))
        at = all_chords.argmin(1)
        number, chord = np.asarray(pivots.column("list"))[at], all_chords[np.arange(len(at)), at]
    return labels.drop_columns(["part"]).append_column("list", pa.array(number, pa.int64())).append_column("chord", pa.array(chord, pa.float64()))


def reached(mail: pa.Table, pivots: pa.Table, limit: float) -> pa.Table:
    """Each mail with the lists that can hold its label; its vector is there once, however many they are."""
    kind = pa.list_(pa.int64())
    if not mail.num_rows or not pivots.num_rows:
        return mail.slice(0, 0).drop_columns(["part"]).append_column("lists", pa.array([], kind))
    numbers = np.asarray(pivots.column("list"))
    if pivots.num_rows == 1 and not pivots.column("v")[0].is_valid:  # labels without a pivot: one list
        count, lists = np.ones(mail.num_rows, np.int64), np.zeros(mail.num_rows, np.int64)
    else:
        centres, found = _vectors(pivots), []
        least, largest = np.asarray(pivots.column("least")), np.asarray(pivots.column("largest"))
        for lo in range(0, mail.num_rows, AT_ONCE):
            chords = _chords(_vectors(mail.slice(lo, AT_ONCE)), centres)
            bound = np.maximum(chords - largest, least - chords)
            found.append(bound <= np.minimum(chords.min(1), limit)[:, None] + SLACK)
        near = np.concatenate(found)
        count, lists = near.sum(1), np.nonzero(near)[1]
    at = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
    return mail.drop_columns(["part"]).append_column("lists", pa.ListArray.from_arrays(at, pa.array(numbers[lists], pa.int64())))


def by_block(mail: pa.Table, pivots: pa.Table, limit: float) -> pa.Table:
    """Each mail with the blocks that can hold its label, and of each block the lists that can."""
    kind = pa.list_(pa.struct([("block", pa.int32()), ("pieces", pa.int32()), ("lists", pa.list_(pa.int32()))]))
    pivots = pivots.sort_by("list")
    numbers, block, pieces, rank = (np.asarray(pivots.column(c)) for c in ("list", "block", "pieces", "rank"))
    out = [reached(mail.slice(0, 0), pivots, limit).drop_columns(["lists"]).append_column("blocks", pa.array([], kind))]
    for lo in range(0, mail.num_rows, AT_ONCE):
        some = reached(mail.slice(lo, AT_ONCE), pivots, limit)
        lists = some.column("lists").combine_chunks()
        at = np.searchsorted(numbers, np.asarray(lists.flatten()))
        of = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        # A mail's lists are in order, and so are their blocks: a block's are next to each other.
        starts = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(block[at], prepend=-1) != 0))
        inner = pa.ListArray.from_arrays(pa.array([*starts, len(at)], pa.int32()), pa.array(rank[at], pa.int32()))
        runs = pa.StructArray.from_arrays([pa.array(block[at[starts]], pa.int32()), pa.array(pieces[at[starts]], pa.int32()), inner], fields=list(kind.value_type))
        ends = pa.array(np.searchsorted(of[starts], np.arange(len(lists) + 1)), pa.int32())
        out.append(some.drop_columns(["lists"]).append_column("blocks", pa.ListArray.from_arrays(ends, runs)))
    return pa.concat_tables(out)


def best_of(mail: pa.Table, labels: pa.Table, threshold: float) -> pa.Table:
    """The most similar label of each mail among those of its ``lists`` in one piece of a block; the first in
    order of equal ones.  A mail without a label above ``threshold`` may be left out."""
    if not mail.num_rows or not labels.num_rows:
        return mail.slice(0, 0).select(["message_id"]).append_column("label", pa.array([], pa.string())).append_column("similarity", pa.array([], pa.float64()))
    # Of equal vectors the first label counts.
    encoded = [(x is not None, (x or "").encode()) for x in labels.column("label").to_pylist()]
    labels = labels.take(sorted(range(labels.num_rows), key=encoded.__getitem__))
    flat = np.asarray(pa.concat_arrays(labels.column("v").chunks).flatten(), np.float64).reshape(labels.num_rows, -1)
    ranks, dim = np.asarray(labels.column("rank")), flat.shape[1]
    keyed = np.concatenate([ranks.astype(np.float64)[:, None], flat], 1)
    first = np.unique(keyed.view(np.dtype((np.void, keyed.itemsize * (dim + 1)))).ravel(), return_index=True)[1]
    del keyed
    first = first[np.argsort(ranks[first], kind="stable")]
    b, names, ranks = flat[first], labels.column("label").take(first), ranks[first]  # by list; ``first`` is the order of labels
    nb = np.sqrt(np.cumsum(b * b, 1)[:, -1])
    units = np.ascontiguousarray((b / np.linalg.norm(b, axis=1, keepdims=True)).astype(np.float32).T)
    known, starts = np.unique(ranks, return_index=True)
    tiles = [(i, lo, min(lo + ACROSS, hi)) for i, (s, hi) in enumerate(zip(starts, [*starts[1:], len(b)], strict=True)) for lo in range(s, hi, ACROSS)]
    # Products of short numbers choose the pairs: they are off by less than ``off``.
    off, out = (dim + 4) * 2.0**-23, []
    for lo in range(0, mail.num_rows, AT_ONCE):
        some = mail.slice(lo, AT_ONCE)
        a = np.asarray(pa.concat_arrays(some.column("v").chunks).flatten(), np.float64).reshape(some.num_rows, -1)
        na, own = np.sqrt(np.cumsum(a * a, 1)[:, -1]), _vectors(some).astype(np.float32)
        if not (np.isfinite(own).all() and np.isfinite(units).all()):
            raise ValueError("vectors must be of finite numbers")
        lists = some.column("lists").combine_chunks()
        of, wanted = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        reach = np.zeros((len(known), len(lists)), bool)
        reach[at[known[at] == wanted], of[known[at] == wanted]] = True
        top = np.full(len(a), threshold - off, np.float64)  # the largest product so far
        best, best_at = np.full(len(a), -np.inf), np.full(len(a), -1)
        for i, left, right in tiles:
            rows = np.flatnonzero(reach[i])
            if not len(rows):
                continue
            near = own[rows] @ units[:, left:right]
            most = near.max(1)
            good = np.flatnonzero(most >= top[rows] - 2 * off)
            if not len(good):
                continue
            rows, near = rows[good], near[good]
            top[rows] = np.maximum(top[rows], most[good])
            r, c = np.nonzero(near >= (top[rows] - 2 * off)[:, None])
            r, c = rows[r], c + left
            # Near the top the sums are taken again one after the other, so that equal labels are equal.
            exact = np.empty(len(r))
            for k in range(0, len(r), PAIRS):
                x, y = r[k : k + PAIRS], c[k : k + PAIRS]
                exact[k : k + PAIRS] = np.cumsum(a[x] * b[y], 1)[:, -1] / (na[x] * nb[y])
            order = np.lexsort((first[c], -exact, r))
            order = order[np.diff(r[order], prepend=-1) != 0]
            r, c, exact = r[order], c[order], exact[order]
            better = (exact > best[r]) | ((exact == best[r]) & (first[c] < first[best_at[r]]))
            best[r[better]], best_at[r[better]] = exact[better], c[better]
        found = np.flatnonzero(best_at >= 0)
        out.append(pa.table({"message_id": some.column("message_id").take(found), "label": names.take(best_at[found]), "similarity": best[found]}))
    return pa.concat_tables(out)


def nearest(mail: DataFrame, labels: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """``by``, message_id, label and similarity of each mail that has a label above ``threshold``.

    ``mail``: by, message_id (once each), v; ``labels``: by, label, v.  Vectors that are null, empty
    or all zeros are compared with nothing.
    """
    by = by or []
    keys = [*by, "dim"]
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & (norm > 0)
    mail = stored(mail.select(*by, F.col("message_id").cast("string"), "v").where(whole).withColumn("dim", F.size("v")), "mail")
    labels = stored(labels.select(*by, "label", "v").where(whole).withColumn("dim", F.size("v")), "labels")
    limit = float(np.sqrt(max(0.0, 2 - 2 * max(threshold, -1.0))))

    sizes = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    every = F.greatest(F.ceil(F.sqrt("n")), F.ceil(F.col("n") / PIVOTS)).cast("long")
    sized = labels.join(sizes, keys).withColumn("pick", F.pmod(F.xxhash64("label", F.lit(7)), every)).drop("n")
    pivots = stored(sized.where("pick = 0").select(*keys, F.monotonically_increasing_id().alias("list"), "v"), "pivots")

    def dealt(rows: DataFrame, key: str, size: int, other: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows in parts of about ``size``, and the other side copied to each part."""
        parts = rows.groupBy(*keys).agg(_parts(F.count(F.lit(1)), size).alias("parts"))
        left = rows.join(parts, keys).withColumn("part", F.pmod(F.xxhash64(key, F.lit(11)), F.col("parts")).cast("int")).drop("parts")
        return left, other.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def types(*names: str) -> str:
        kinds = dict(mail.dtypes) | {"label": "string", "list": "bigint", "held": "int", "blocks": "array<struct<block: int, pieces: int, lists: array<int>>>", "chord": "double", "similarity": "double"}
        return ", ".join(f"{n} {kinds[n]}" for n in names)

    # Labels to the lists of their pivots, and the chords of each list.
    left, right = dealt(labels, "label", MAIL, pivots)
    listed = left.groupBy(*keys, "part").cogroup(right.groupBy(*keys, "part")).applyInArrow(to_lists, types(*by, "label", "v", "dim", "list", "chord"))
    listed = stored(listed, "lists")
    lists = listed.groupBy(*keys, "list").agg(F.min("chord").alias("least"), F.max("chord").alias("largest"), F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy(*keys).orderBy("list")  # about as many rows as there are pivots
    before = F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lists = lists.withColumn("rank", F.row_number().over(in_order)).withColumn("block", F.floor(before / _room(PART)).cast("int"))
    whole_block = F.sum("n").over(Window.partitionBy(*keys, "block"))
    lists = lists.withColumn("pieces", F.greatest(F.lit(1), F.round(whole_block / _room(PART))).cast("int"))
    lists = stored(lists.join(pivots, [*keys, "list"], "left"), "chords")

    # Mail to the blocks that can hold its label; its part in the blocks is known before.
    left, right = dealt(mail, "message_id", MAIL, lists.drop("n"))
    held = F.greatest(_parts(F.count(F.lit(1)), _room(HELD)), F.least(F.lit(SPREAD), _parts(F.count(F.lit(1)), max(1, MAIL // 2))))
    held = stored(mail.groupBy(*keys).agg(held.alias("held_parts")), "held")
    left = left.join(held, keys).withColumn("held", F.pmod(F.xxhash64("message_id", F.lit(17)), F.col("held_parts")).cast("int")).drop("held_parts")
    reach = left.groupBy(*keys, "part").cogroup(right.groupBy(*keys, "part")).applyInArrow(lambda m, p: by_block(m, p, limit), types(*by, "message_id", "v", "dim", "held", "blocks"))
    reach = stored(reach, "reach").withColumn("b", F.explode("blocks")).select(*keys, "message_id", "v", "held", "b.*")

    # Pieces of a block's labels against parts of its mail.
    placed = listed.join(lists.select(*keys, "list", "rank", "block", "pieces"), [*keys, "list"])
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("label", F.lit(13)), F.col("pieces")).cast("int")).drop("pieces", "chord", "list")
    right = placed.join(held, keys).withColumn("held", F.explode(F.sequence(F.lit(0), F.col("held_parts") - 1))).drop("held_parts")
    left = reach.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    group = [*keys, "block", "piece", "held"]

    def compare(m: pa.Table, c: pa.Table) -> pa.Table:
        out = best_of(m, c, threshold)
        for name in reversed(by):
            column = m.column(name).slice(0, out.num_rows) if m.num_rows else pa.array([], m.schema.field(name).type)
            out = out.add_column(0, name, column)
        return out

    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compare, types(*by, "message_id", "label", "similarity"))
    top = F.min(F.struct((-F.col("similarity")).alias("s"), "label")).alias("b")
    best = found.where(F.col("similarity") > threshold).groupBy(*by, "message_id").agg(top)
    return best.select(*by, "message_id", F.col("b.label").alias("label"), (-F.col("b.s")).alias("similarity"))
