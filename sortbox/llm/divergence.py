"""Divergence audit between sources of a language, by sparse merges of pairs.

Each source of a language (a group) has counts of the language's kept terms.  With one added to each
count a term's share in parts per 1,000,000,000 is ``p = 1 + floor(1e9 * (count + 1) / (N + V))``, and
a term tells a group from another by ``floor((p - q) * (p - q) / q)``.  Results are whole numbers and
exact: divisions are long divisions on integers.

Terms are counted in one scan: each task adds up its documents' counts and passes them on when it holds
``HELD`` of them, so that a common term or a hot source is a few rows of each task.  Kept terms get
numbers; a group's counts become sorted (term number, count) arrays, cut into stretches of at most
``2**STRETCH`` numbers.  The sources of a language are dealt to blocks of about ``BLOCK``; a pair task
holds one stretch of two blocks and merges the arrays of each unordered pair once, for both
directions: a galloping intersection prices the terms of both, then come the terms of one side only;
terms of neither all cost the same and are counted.  A task's memory is bounded by two blocks of
stretches, whatever a source's size.

Null text, language and source are read as ''.  A group without kept terms has a row for each other
source and no term rows; a language with one source has no pair rows.  Repeated rows count as often as
they occur, an empty table gives an empty result.  Texts are read whole, in slices that end between
terms.  Columns of the input other than text, lang and source are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sortbox.llm.tables import stored

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP = 200
HELD = 800_000
STRETCH = 16
BLOCK = 8
STEP = 1024  # terms of the shorter array that one gallop places
SLICE = 1 << 20
BREAK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
# Bytes of UTF-8 text: A-Z to lower case, other letters and all that is not ASCII as it is, the rest a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
CELLS = "lang string, source string, item string, value bigint, either bigint"


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, slice by slice."""
    at = 0
    while at < len(text):
        stop = BREAK.search(text, at + SLICE)
        end = stop.start() if stop else len(text)
        yield text[at:end].translate(PLAIN).split()
        at = end


def term_counts(docs: DataFrame, text: str = "text", held: int = HELD) -> DataFrame:
    """Occurrences and documents of each (lang, source, term); each group also has a row without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        in_docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in n.items():
                terms, m = list(counts), len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (m + 1)),
                        pa.array([source] * (m + 1)),
                        pa.array([None, *terms], pa.binary()).cast(pa.string()),
                        pa.array([0, *counts.values()], pa.int64()),
                        pa.array([0, *map(in_docs[lang, source].__getitem__, terms)], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            n.clear()
            in_docs.clear()

        for batch in batches:
            for body, lang, source in zip(*batch.columns, strict=True):
                group = lang.as_py() or "", source.as_py() or ""
                before, distinct = len(n[group]), set()
                for terms in text_terms(body.as_buffer().to_pybytes() if body.is_valid else b""):
                    n[group].update(terms)
                    distinct.update(terms)
                in_docs[group].update(distinct)
                size += len(n[group]) - before
                if size >= held:
                    yield from flush()
                    size = 0
        yield from flush()

    parts = docs.select(F.col(text).cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(run, COUNTS)
    # Rows of a task are nearly all different: they are dealt first, then added up.
    return parts.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)`` by long division, three digits at a time."""
    out, rest = np.divmod(counts.astype(np.int64) + 1, total)
    for _ in range(3):  # 1000 ** 3 = SCALE; a rest is below the total
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def cost(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    return (p - q) * (p - q) // q


def intersect(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted arrays of the values they share, by galloping through the longer one.

    From where the last stretch of the shorter array ended, the step through the longer one doubles
    until it is past the next stretch's last value; the stretch is then placed inside that window.
    """
    left, right, at = [], [], 0
    for begin in range(0, len(short), STEP):
        part = short[begin : begin + STEP]
        step, end = 1, at
        while end < len(long) and long[end] <= part[-1]:
            end = at + step
            step *= 2
        window = long[at : min(end, len(long))]
        if not len(window):
            if at >= len(long):
                break
            continue
        place = np.searchsorted(window, part)
        same = np.flatnonzero(window[np.minimum(place, len(window) - 1)] == part)
        left.append(same + begin)
        right.append(place[same] + at)
        at += int(place[-1])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def merge(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> tuple[int, int, int]:
    """Cost of a against b and of b against a over the terms of either, and how many those are.

    A side is its sorted terms, their counts, and its group's total (occurrences and kept terms).
    """
    if len(a[0]) > len(b[0]):
        there, back, either = merge(b, a)
        return back, there, either
    (ta, ca, na), (tb, cb, nb) = a, b
    none_a, none_b = 1 + SCALE // na, 1 + SCALE // nb  # the share of a term that does not occur
    pa_, pb = shares(ca, na), shares(cb, nb)
    i, j = intersect(ta, tb)
    only_a, only_b = np.delete(pa_, i), np.delete(pb, j)
    both_a, both_b = pa_[i], pb[j]
    there = int(cost(both_a, both_b).sum()) + int(cost(only_a, none_b).sum()) + int(cost(np.int64(none_a), only_b).sum())
    back = int(cost(both_b, both_a).sum()) + int(cost(np.int64(none_b), only_a).sum()) + int(cost(only_b, none_a).sum())
    return there, back, len(ta) + len(tb) - len(i)


def pair_task(key: tuple, table: pa.Table) -> pa.Table:
    """Costs of all pairs between two blocks over one stretch of terms, in both directions."""
    lang, _, block_i, block_j = (k.as_py() for k in key)
    sides = []
    for r in range(table.num_rows):
        arrays = (np.asarray(table.column(c)[r].values) if table.column(c)[r].is_valid else np.empty(0, np.int64) for c in ("terms", "counts"))
        sides.append((table.column("source")[r].as_py(), table.column("block")[r].as_py(), *arrays, table.column("total")[r].as_py()))
    sides.sort(key=lambda s: s[0])
    rows = []
    for x, (s, s_block, *s_side) in enumerate(sides):
        for t, t_block, *t_side in sides[x + 1 :]:
            if {s_block, t_block} != {block_i, block_j}:
                continue  # two sources of one of two blocks belong to that block's own task
            there, back, either = merge(tuple(s_side), tuple(t_side)) if s_side[-1] else (0, 0, 0)  # 0: no kept terms
            rows += [(lang, s, t, there, either), (lang, t, s, back, either)]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.string()] * 3 + [pa.int64()] * 2
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in CELLS.split(", ")])


def _share(n: str, total: str) -> str:
    """The share as SQL, exact at any size (a decimal's ``div`` is whole)."""
    return f"(1 + (cast({n} + 1 as decimal(20,0)) * {SCALE}BD) div cast({total} as decimal(20,0)))"


def audit(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, stretch: int = STRETCH, held: int = HELD) -> DataFrame:
    """``lang, source, part, item, value, rank``; part ``pair`` against each other source of the
    language, part ``term`` the ``top`` terms that a source has more of than its language.
    """
    counts = stored(term_counts(docs, text, held), "divergence-counts")
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    kept = stored(kept.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("id")), "divergence-kept")
    numbered = stored(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-terms")

    langs = counts.where("term is null").groupBy("lang").agg(F.count("*").alias("sources"))
    of_lang = kept.groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"), F.collect_set(F.shiftright("id", stretch)).alias("stretches")
    )
    sums = numbered.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    # Where no term is kept there is nothing to add up: one empty stretch and a total of 0.
    groups = counts.where("term is null").select("lang", "source").join(langs, "lang").join(of_lang, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.select(
        "lang",
        "source",
        F.coalesce("v", F.lit(0)).alias("v"),
        (F.coalesce("group_n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"),
        (F.coalesce("lang_total", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_total"),
        F.ceil(F.col("sources") / block).cast("int").alias("blocks"),
        F.coalesce("stretches", F.array(F.lit(0).cast("long"))).alias("stretches"),
    )
    groups = stored(groups.withColumn("block", F.expr("pmod(xxhash64(lang, source), blocks)").cast("int")), "divergence-groups")
    result = pairs(numbered, groups, stretch).unionByName(telling_terms(numbered, groups, top))
    return result.select("lang", "source", "part", "item", "value", "rank")


def pairs(numbered: DataFrame, groups: DataFrame, stretch: int) -> DataFrame:
    """Each source against each other one of its language."""
    cell = F.struct("id", "n")
    arrays = numbered.groupBy("lang", "source", F.shiftright("id", stretch).alias("stretch")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    arrays = arrays.select("lang", "source", "stretch", F.col("cells.id").alias("terms"), F.col("cells.n").alias("counts"))
    sides = groups.select("lang", "source", "total", "block", "blocks", F.explode("stretches").alias("stretch")).join(arrays, ["lang", "source", "stretch"], "left")
    dealt = sides.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("*", F.least("block", "other").alias("block_i"), F.greatest("block", "other").alias("block_j")).drop("other", "blocks")
    cells = dealt.groupBy("lang", "stretch", "block_i", "block_j").applyInArrow(pair_task, CELLS)
    summed = cells.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("either").alias("either"))
    own = groups.select("lang", "source", "v", "total")
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    priced = summed.join(own, ["lang", "source"]).join(other, ["lang", "item"])
    p, q = f"(1 + {SCALE} div total)", f"(1 + {SCALE} div item_total)"
    absent = F.expr(f"if(v = 0, 0, (v - either) * ((({p} - {q}) * ({p} - {q})) div {q}))")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return priced.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + absent).alias("value")).withColumn("rank", F.row_number().over(order))


def telling_terms(numbered: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms that a source has more of than its whole language, the most telling first."""
    priced = numbered.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    priced = priced.withColumn("p", F.expr(_share("n", "total"))).withColumn("q", F.expr(_share("lang_n", "lang_total"))).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    priced = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    return priced.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
