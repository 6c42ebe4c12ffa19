"""Near-duplicates: one-permutation MinHash, banded buckets, star-shaped candidate edges.

A document's set holds its distinct shingles.  One hash spreads the set over ``BINS`` bins and keeps
the least value of each; an empty bin takes the value of a filled one chosen by a hash of the bin's
number and the attempt (optimal densification).  ``BANDS`` bands of ``ROWS`` bins make the buckets:
a pair at similarity 0.8 shares none of them with a chance of about (1 - 0.8^4)^32 = 5e-8.

Documents with the same set form one class and only its least id goes on.  In each bucket every
class is paired with the bucket's least class, so a bucket of n makes n - 1 candidates, and each is
confirmed on the full sets.  What the stars leave open is a bucket whose classes are in different
components: there the signatures of the classes are compared block by block, and classes of
different components that may be similar (five standard deviations) are compared on their full
sets.  Blocks bound memory, links of a block form a forest, and no pair is listed.

Lower case: A-Z only.  Null text, or text without words: empty set, linked with nothing.  Repeated
rows are equal documents.  Rows without an id are kept and linked with nothing.  An empty table gives an empty result; columns other than the named ones
are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortbox.llm import text as T
from sortbox.llm.components import components
from sortbox.llm.tables import stored

BINS = 128
BANDS = 32
ROWS = BINS // BANDS
PERCENT = 80
BLOCK = 512  # classes of a bucket compared with as many others at once
SHINGLE = 4
_EMPTY = np.uint32(0xFFFFFFFF)


def shingle_sets(c: T.Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row and value, and the row bounds."""
    words, n_words = c.hashes(), np.diff(c.bounds)
    h, rows = T.rolling(words, k), c.rows()
    whole = rows[: len(h)] == rows[k - 1 :] if len(h) else np.empty(0, bool)
    value, row = h[whole], rows[: len(h)][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):  # the whole sequence is the only shingle
        own = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = n_words[short] > i
            own[has] = T.mix(own[has] + words[c.bounds[short][has] + i] * np.uint64(2 * i + 3) + np.uint64(i + 1))
        value, row = np.concatenate([value, own]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    ends = np.searchsorted(row, np.arange(len(c) + 1)).tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(c) + 1))


def signatures(value: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified one-permutation signature of every row; rows with an empty set keep ``_EMPTY``."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    h = T.mix(value ^ np.uint64(0x5851F42D4C957F2D))
    sig = np.full(n * bins, _EMPTY, np.uint32)
    slot = row.astype(np.uint64) * np.uint64(bins) + (h >> np.uint64(32)) % np.uint64(bins)
    low = np.minimum(h & np.uint64(0xFFFFFFFF), np.uint64(_EMPTY - 1))
    both = np.sort(slot << np.uint64(32) | low)
    slot = (both >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    sig[slot[first]] = both[first].astype(np.uint32)
    sig = sig.reshape(n, bins)
    filled = sig != _EMPTY
    open_rows, open_bins = np.nonzero(~filled & (np.diff(bounds) > 0)[:, None])
    attempt = 0
    while len(open_rows):
        donor = (T.mix((open_bins * 1_000_003 + attempt).astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
        ok = filled[open_rows, donor]
        sig[open_rows[ok], open_bins[ok]] = sig[open_rows[ok], donor[ok]]
        open_rows, open_bins, attempt = open_rows[~ok], open_bins[~ok], attempt + 1
    return sig


def _read_sets(docs: DataFrame, text: str, k: int, with_sets: bool) -> DataFrame:
    """Per document: set size and a 128-bit hash of the set, with the signature or with the set."""
    name = "shingles" if with_sets else "sig"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in T.chunks(batch.column(1), lower=True):
                value, bounds = shingle_sets(c, k)
                size = np.diff(bounds)
                totals = []
                for salt in (1, 2):
                    sums = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(T.mix(value + np.uint64(salt * 0x1234567)), out=sums[1:])
                    totals.append(T.mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64)).view(np.int64))
                parts = [value[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] if with_sets else list(signatures(value, bounds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[c.lo : c.hi], pa.array(size.astype(np.int64)), *(pa.array(t) for t in totals), T.binary(parts)],
                    ["doc_id", "n_shingles", "set_a", "set_b", name],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, {name} binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(``bucket``, ``doc_id``) of every class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS))
            for i in range(ROWS):
                key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(T.column(batch, "doc_id").to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n))],
                ["bucket", "doc_id", "band"],
            )

    return classes.select("doc_id", "sig").mapInArrow(run, "bucket bigint, doc_id bigint, band int")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least this percentage of their union in common."""
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    merged = np.concatenate([a, b])
    merged.sort(kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (both - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that are linked on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = sets.select("doc_id", "shingles")
    joined = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").join(own.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _floor(n: np.ndarray, percent: int) -> np.ndarray:
    """Least share of equal bins that a linked pair has, five standard deviations below."""
    p = percent / 100
    return p - 5 * np.sqrt(p * (1 - p) / np.maximum(1, np.minimum(n, BINS)))


def _blocks(members: DataFrame) -> DataFrame:
    """Deal each bucket's members to blocks; each pair of blocks of a bucket is one group.

    A bucket of n classes has about (n / BLOCK)^2 / 2 groups of at most 2 x BLOCK rows or so.
    """
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("*", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def _open_links(classes: DataFrame, buckets: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes that share a bucket and that the stars left in different components."""
    labelled = buckets.join(linked.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # The only pair of a bucket of two is a star's.
    open_buckets = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    open_buckets = open_buckets.where("x < y and n > 2").select("bucket")
    members = labelled.join(open_buckets, "bucket").join(classes.select("doc_id", "n_shingles", "sig"), "doc_id")

    def may_link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group), BINS)
        n, comp = group["n_shingles"].to_numpy(), group["component"].to_numpy()
        low, high, band = group["low"].iloc[0], group["high"].iloc[0], group["band"].iloc[0]
        own = group["own"].to_numpy()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        active = np.zeros(len(group), bool)
        for i in left.tolist():
            equal = sig[right] == sig[i]
            # Only in the first band that the two share: each pair is looked at once.
            first = equal.reshape(len(right), BANDS, ROWS).all(2).argmax(1) == band
            big, small = np.maximum(n[right], n[i]), np.minimum(n[right], n[i])
            near = first & (comp[right] != comp[i]) & (100 * small >= percent * big) & (equal.mean(1) >= _floor(small, percent))
            if near.any():
                active[i] = True
                active[right[near]] = True
        return group.loc[active, ["bucket", "doc_id", "component", "own", "low", "high", "band"]]

    kind = "bucket bigint, doc_id bigint, component bigint, own int, low int, high int, band int"
    keys = ["bucket", "low", "high"]
    # Components may differ in a bucket without any pair that is near: most rows end here.
    near = _blocks(members).groupBy(*keys).applyInPandas(may_link, kind)

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id").reset_index(drop=True)
        own, comp, ids = group["own"].to_numpy(), group["component"].to_numpy(), group["doc_id"].to_numpy()
        low, high = group["low"].iloc[0], group["high"].iloc[0]
        values = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        root = {c: c for c in comp.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        right = np.flatnonzero(own == high).tolist()
        for i in np.flatnonzero(own == low).tolist():
            for j in right:
                x, y = find(comp[i]), find(comp[j])
                if x != y and _similar(values[i], values[j], percent):
                    root[max(x, y)] = min(x, y)
                    found.append((ids[i], ids[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return near.join(sets.select("doc_id", "shingles"), "doc_id").groupBy(*keys).applyInPandas(links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document."""
    base = stored(_read_sets(docs, text, k, False), "near-dup-base")
    full = base.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "near-dup-classes")
    buckets = _buckets(classes)
    hubs = buckets.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub < top").select("bucket", "hub")
    shared = stored(buckets.join(hubs, "bucket"), "near-dup-buckets")
    pairs = shared.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    # Full sets of the classes that share a bucket.
    needed = shared.select("doc_id").distinct()
    sets = stored(_read_sets(docs.join(needed, "doc_id", "left_semi"), text, k, True), "near-dup-sets")
    stars = stored(_confirmed(pairs, sets, percent), "near-dup-stars")
    linked = components(stars)
    rest = stored(_open_links(classes, shared, linked, sets, percent), "near-dup-rest")
    if not rest.isEmpty():
        linked = components(stars.union(rest))
    member = classes.select("set_a", "set_b", F.col("doc_id").alias("node")).join(linked, "node", "left")
    member = member.select("set_a", "set_b", F.coalesce("component", "node").alias("component_id"))
    # Sets that are empty have no class; the row keeps its own id.
    out = base.select("doc_id", "n_shingles", "set_a", "set_b").join(member, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
