"""Gradient boosting with leaf-wise trees from histograms.

The application's settings: trees of at most 31 leaves, grown best-first; learning rate 0.05; 80 % of
the features for each tree; 80 % of the rows, drawn anew every five trees; at most 200 trees, and the
number kept is that with the best AUC on the test rows, training ends once 20 trees have not bettered it.

Values are put into at most ``max_bin`` bins of each feature, whose bounds are quantiles over all training rows.
The binned rows are a stored table.  In a pass every task adds up gradients and curvatures of its rows
by (node, feature, bin); the tasks' histograms are summed by (node, feature), and only the best split
of each node in each partition comes to the driver.  A pass prepares the children of every node whose split is
known and whose turn may come, so that a tree takes about as many passes as it has levels, not one for
each of its 30 splits.

Training rows whose bins take at most ``AT_HAND`` bytes need no passes: one task holds them and grows
``BLOCK`` trees, so that a block is one Spark job.  More rows than that are never put into one task.  Both
ways give the same trees.

Sums are of whole numbers (``SCALE`` units), so they do not depend on the order of rows, on partitions
or on a task that runs again: the same bounds give the same trees.  (Bounds are approximate quantiles,
to 1 / ``ACCURACY`` of the rows; up to that many rows they are exact.)  A row's margin is stored every
``BLOCK`` trees; tasks add the trees since.

The rows' ids must be unique.  Without rows, or with one class only, there are no trees and every
score is the share of the class.  A value that is not a number goes to the last bin.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SCALE = 1 << 24
BLOCK = 10  # trees between two writes of the margins
MAX_HISTOGRAM_BYTES = 128 << 20  # of a task's pass
AT_HAND = 64 << 20  # bytes of bins that one task may hold
ACCURACY = 10_000  # of the quantiles
DRAWS = 1 << 20  # a row's place in the draw of rows
CELLS = 1 << 21  # (row, feature) pairs that a task counts at once, unless the histograms are longer


@dataclass(frozen=True)
class Settings:
    leaves: int = 31
    rate: float = 0.05
    feature_share: float = 0.8
    row_share: float = 0.8
    row_every: int = 5
    rounds: int = 200
    patience: int = 20
    max_bin: int = 255
    min_rows: int = 20
    min_curvature: float = 1e-3
    seed: int = 42


@dataclass
class Tree:
    """Node 0 is the root; a node without a feature (-1) is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, gain: float) -> tuple[int, int]:
        """Make a leaf an inner node: rows whose bin is at most ``at`` go left."""
        left, right = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.left[node], self.right[node], self.gain[node] = feature, at, left, right, gain
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0)):
            column += [empty, empty]
        return left, right

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, at, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows := rows[feature[node[rows]] >= 0]):
            n = node[rows]
            node[rows] = np.where(bins[rows, feature[n]] <= at[n], left[n], right[n])
        return node

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Model:
    names: list[str]
    bounds: list[list[float]]  # of each feature: the largest value of each bin but the last
    base: float
    trees: list[Tree]
    aucs: list[float]  # on the test rows, after each tree that was tried

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.bounds)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.bins(x), np.full(len(x), self.base)
        for tree in self.trees:
            out = out + tree.margins(bins)
        return out

    def importance(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        gain = dict.fromkeys(self.names, 0.0)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    gain[self.names[f]] += g
        total = sum(gain.values()) or 1.0
        return {k: v / total for k, v in gain.items()}

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        spec = json.loads(text)
        return Model(**{**spec, "trees": [Tree(**t) for t in spec["trees"]]})


def binned(x: np.ndarray, bounds: Sequence[Sequence[float]]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, at in enumerate(bounds):
        out[:, f] = np.searchsorted(np.asarray(at, np.float64), x[:, f], side="left")
    return out


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-m))


def gradients(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the log loss, as whole numbers of ``1 / SCALE``."""
    p = sigmoid(margins)
    return np.rint((p - y) * SCALE).astype(np.int64), np.rint(p * (1 - p) * SCALE).astype(np.int64)


def best_split(sums: np.ndarray, s: Settings) -> tuple[float, int, int, list[int], list[int]]:
    """Gain, feature, bin, left sums and all sums of the best cut of (features x bins x 3) sums.

    Of equal gains the first feature's first bin wins; the gain is -1 if nothing can be cut.
    """
    left = np.cumsum(sums, 1)
    whole = left[:, -1:]
    right = whole - left
    ok = (np.minimum(left[..., 2], right[..., 2]) >= s.min_rows) & (np.minimum(left[..., 1], right[..., 1]) >= s.min_curvature * SCALE)
    g, h = [np.stack([left[..., j], right[..., j]]).astype(np.float64) for j in (0, 1)]
    before = whole[0, 0, :2].astype(np.float64)
    gain = np.where(ok, (g * g / np.maximum(h, 1)).sum(0) - before[0] * before[0] / max(before[1], 1), -1.0)
    feature, at = np.unravel_index(int(gain.argmax()), gain.shape)
    best = float(gain[feature, at])
    return best / SCALE if best > 0 else -1.0, int(feature), int(at), left[feature, at].tolist(), whole[0, 0].tolist()


def grown_at_hand(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, features: list[int], s: Settings) -> Tree | None:
    """The best-first tree of rows that are at hand, as ``Trainer.grow`` makes it; None when the root cannot be split.

    ``bins``: features x rows.  Of two children the histograms of the smaller one are counted, the other's are the rest.
    """
    used, grads, curves = np.array(features), g.astype(np.float64), h.astype(np.float64)

    def count(at: np.ndarray) -> np.ndarray:
        out, ga, ha = np.empty((len(used), s.max_bin, 3), np.int64), grads[at], curves[at]
        for i, f in enumerate(used):
            b = bins[f][at].astype(np.intp)
            # Sums of whole numbers below 2 ** 53 are exact as doubles.
            out[i, :, 0], out[i, :, 1], out[i, :, 2] = np.bincount(b, ga, s.max_bin), np.bincount(b, ha, s.max_bin), np.bincount(b, minlength=s.max_bin)
        return out

    tree, order, room = Tree(), [], s.leaves - 1
    at, path, sums, best = {0: rows}, {0: 1}, {}, {}

    def open_leaf(node: int, histograms: np.ndarray | None) -> None:
        if histograms is not None:
            sums[node], best[node] = histograms, best_split(histograms, s)

    open_leaf(0, count(rows) if len(rows) else None)
    whole = {0: best[0][4]} if best else {}
    while room and (ready := [n for n in at if best.get(n, (-1.0,))[0] > 0]):
        top = min(ready, key=lambda n: (-best[n][0], path[n]))
        gain, i, cut, left, total = best.pop(top)
        a, b = tree.split(top, int(used[i]), cut, gain)
        here, before = at.pop(top), sums.pop(top)
        goes = bins[used[i]][here] <= cut
        at[a], at[b] = here[goes], here[~goes]
        path[a], path[b] = 2 * path[top], 2 * path[top] + 1
        whole[a], whole[b] = left, [w - x for w, x in zip(total, left, strict=True)]
        order.append(top)
        room -= 1
        few = 2 * s.min_rows  # fewer rows are never split
        if room and max(len(at[a]), len(at[b])) >= few:
            small, large = (a, b) if len(at[a]) <= len(at[b]) else (b, a)
            counted = count(at[small])
            open_leaf(large, before - counted)
            open_leaf(small, counted if len(at[small]) >= few else None)
    return kept(tree, order, whole, s) if order else None


def kept(made: Tree, order: list[int], sums: dict[int, list[int]], s: Settings) -> Tree:
    """The tree of the splits ``order``, in that order; a leaf's value is its Newton step."""
    out, number = Tree(), {0: 0}
    for node in order:
        left, right = out.split(number[node], made.feature[node], made.bin[node], made.gain[node])
        number[made.left[node]], number[made.right[node]] = left, right
    for node in number.keys() - set(order):
        g, h, _ = sums[node]
        out.value[number[node]] = -s.rate * g / h
    return out


def row_draw(column: str, seed: int, period: int):
    """Place of a row in a draw: less than ``row_share * DRAWS`` takes part."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed), F.lit(period)), F.lit(DRAWS))


def drawn_features(n: int, tree: int, s: Settings) -> list[int]:
    take = max(1, round(n * s.feature_share))
    return sorted(np.random.default_rng((s.seed, tree)).choice(n, take, replace=False).tolist())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of equal lengths, or of a binary one of equal sizes."""
    if pa.types.is_binary(column.type):
        data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.empty(0, np.uint8)
        offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
        return data[offset : offset + len(column) * width].reshape(len(column), width)
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, f"boosting/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Trainer:
    """Binned rows in a stored table and the trees so far."""

    def __init__(self, rows: DataFrame, names: list[str], s: Settings, key: str, label: str, features: str, is_test: str):
        self.s, self.names = s, names
        train = rows.where(~F.col(is_test))
        self.bounds = self._quantiles(train, features)
        n, positive = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
        self.one_class = positive in (0, n)
        histograms = 24 * s.max_bin * max(1, round(len(names) * s.feature_share)) * (s.leaves + 1)
        self.at_hand = n * len(names) <= AT_HAND and histograms <= MAX_HISTOGRAM_BYTES
        share = min(max(positive / n if n else 0.5, 1e-9), 1 - 1e-9)
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[Tree] = []
        self.stored_trees = 0
        bounds, width, base = self.bounds, len(names), self.base

        def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = binned(_matrix(b.column(3), width), bounds)
                data = pa.array([r.tobytes() for r in made], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], data, pa.array(np.full(b.num_rows, base))], ["key", "y", "is_test", "bins", "margin"])

        ready = rows.select(F.xxhash64(key).alias("key"), F.col(label).cast("int").alias("y"), F.col(is_test).alias("is_test"), F.col(features).alias("x"))
        self.table = stored(ready.mapInArrow(bins, "key bigint, y int, is_test boolean, bins binary, margin double"))

    def _quantiles(self, train: DataFrame, features: str) -> list[list[float]]:
        """Bounds of the bins: at most ``max_bin`` - 1 quantiles of each feature, over all rows."""
        k = self.s.max_bin - 1
        each = train.select(F.posexplode(features).alias("f", "v")).where(~F.isnan("v"))
        shares = F.array(*[F.lit((i + 1) / (k + 1)) for i in range(k)])
        found = each.groupBy("f").agg(F.array_distinct(F.percentile_approx("v", shares, F.lit(ACCURACY))).alias("q"), F.max("v").alias("top")).collect()
        by_feature = {r["f"]: [v for v in r["q"] if v < r["top"]] for r in found}
        return [by_feature.get(f, []) for f in range(len(self.names))]

    def splits(self, grown: Tree, wanted: list[int], features: list[int], tree: int) -> dict[int, tuple[float, int, int, list[int], list[int]]]:
        """Of each wanted leaf: gain, feature, bin, left sums and all sums of its best split (gain -1: none)."""
        s, width, since = self.s, len(self.names), self._since()
        used = np.array(features)
        place = np.full(len(grown.feature), -1)
        place[wanted] = np.arange(len(wanted))
        size = s.max_bin

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(wanted) * len(used) * size, 3), np.int64)
            waiting, rows = [], 0
            # Adding to the histograms costs their length, so the rows of several batches are added at once.
            enough = max(1, max(CELLS, len(sums)) // max(1, len(used)))

            def add() -> None:
                at, g, h = (np.concatenate([w[j] for w in waiting]) for j in (0, 1, 2))
                bins = np.concatenate([w[3] for w in waiting])
                for lo in range(0, len(at), enough):
                    cut = slice(lo, lo + enough)
                    cells = ((at[cut, None] * len(used) + np.arange(len(used))) * size + bins[cut]).ravel()
                    for j, v in enumerate((g, h)):
                        # Sums of whole numbers below 2 ** 53 are exact as doubles.
                        sums[:, j] += np.bincount(cells, np.repeat(v[cut], len(used)), len(sums)).astype(np.int64)
                    sums[:, 2] += np.bincount(cells, minlength=len(sums))
                waiting.clear()

            for b in batches:
                bins = _matrix(b.column(1), width)
                at = place[grown.nodes(bins)]
                keep = at >= 0
                bins, margins = bins[keep], np.asarray(b.column(2))[keep]
                for t in since:
                    margins = margins + t.margins(bins)
                waiting.append((at[keep], *gradients(margins, np.asarray(b.column(0))[keep]), bins[:, used]))
                rows += len(bins)
                if rows >= enough:
                    add()
                    rows = 0
            if waiting:
                add()
            whole = sums.reshape(len(wanted), len(used), size, 3)
            for i in np.flatnonzero(whole[:, 0, :, 2].any(1)) if len(used) else ():
                cells = []  # of each feature: bin and sums where there are rows
                for of_feature in whole[i]:
                    at = np.flatnonzero(of_feature[:, 2])
                    cells.append(np.concatenate([at[:, None], of_feature[at]], 1).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([wanted[i]] * len(used), pa.int32()), pa.array(features, pa.int32()), pa.array(cells, pa.binary())], ["node", "feature", "cells"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums the sorted histograms of a partition, node by node."""
            total: dict[int, np.ndarray] = {}
            node, found = None, []

            def close() -> None:
                if total:
                    gain, i, at, left, whole = best_split(np.stack(list(total.values())), s)
                    found.append({"node": node, "feature": list(total)[i], "gain": gain, "at": at, "left": left, "whole": whole})
                    total.clear()

            for b in batches:
                for n, f, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if n != node:
                        close()
                        node = n
                    if f not in total:
                        total[f] = np.zeros((size, 3), np.int64)
                    part = np.frombuffer(cells.as_buffer(), np.int64).reshape(-1, 4)
                    total[f][part[:, 0]] += part[:, 1:]
            close()
            yield pa.RecordBatch.from_pylist(found, schema=chosen)

        chosen = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("gain", pa.float64()), ("at", pa.int32()), ("left", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64()))])
        part = F.lit(True) if s.row_share >= 1 else row_draw("key", s.seed, tree // s.row_every) < int(s.row_share * DRAWS)
        train = self.table.where(~F.col("is_test") & part).select("y", "bins", "margin")
        dealt = train.mapInArrow(add_up, "node int, feature int, cells binary").repartition("node", "feature").sortWithinPartitions("node", "feature")
        found = dealt.mapInArrow(choose, "node int, feature int, gain double, at int, left array<bigint>, whole array<bigint>").collect()
        out: dict[int, tuple[float, int, int, list[int], list[int]]] = {}
        for r in sorted(found, key=lambda r: (-r["gain"], r["feature"])):
            out.setdefault(r["node"], (r["gain"], r["feature"], r["at"], r["left"], r["whole"]))
        return out

    def _since(self) -> list[Tree]:
        return self.trees[self.stored_trees :]

    def grow(self, number: int) -> Tree | None:
        """One best-first tree; None when the root cannot be split."""
        s, features = self.s, drawn_features(len(self.names), number, self.s)
        at_once = 2 * max(1, MAX_HISTOGRAM_BYTES // (48 * s.max_bin * max(1, len(features))))  # children come in pairs
        made, open_leaves = Tree(), 1  # ``made`` also holds prepared children, which may not be used
        known = self.splits(made, [0], features, number)
        if known.get(0, (-1,))[0] <= 0:
            return None
        sums = {0: known[0][4]}
        leaves, inner, parent = {0}, [], {}
        path = {0: 1}  # of equal gains the node further up or to the left is first, in whatever pass it was prepared
        while open_leaves < s.leaves:
            ready = sorted((n for n in leaves if known[n][0] > 0), key=lambda n: (-known[n][0], path[n]))
            if not ready:
                break
            top, room = ready[0], s.leaves - open_leaves
            if made.left[top] < 0 or made.left[top] not in known and room > 1:
                # A node's turn comes after its parent's, so it ranks with the least gain on its way
                # down; only the first ``room`` can still become inner nodes of this tree.
                rank = {}
                for n in (n for n in range(len(made.feature)) if n not in inner and known.get(n, (-1,))[0] > 0):
                    rank[n] = min(known[n][0], rank.get(parent.get(n), float("inf")))
                for n in sorted(rank, key=lambda n: (-rank[n], path[n]))[:room]:
                    if made.left[n] < 0:
                        gain, feature, at, left, whole = known[n]
                        a, b = made.split(n, feature, at, gain)
                        sums[a], sums[b] = left, [w - x for w, x in zip(whole, left, strict=True)]
                        parent[a] = parent[b] = n
                        path[a], path[b] = 2 * path[n], 2 * path[n] + 1
                if room > 1:
                    of = sorted((n for n in rank if made.left[n] >= 0), key=lambda n: (-rank[n], path[n]))
                    wanted = [c for n in of for c in (made.left[n], made.right[n]) if c not in known][:at_once]
                    found = self.splits(made, wanted, features, number)
                    known |= {c: found.get(c, (-1.0, 0, 0, [], [])) for c in wanted}
            leaves.remove(top)
            inner.append(top)
            leaves |= {made.left[top], made.right[top]}
            open_leaves += 1
        return kept(made, inner, sums, s)

    def grow_passes(self, trees: int) -> int:
        """Add the next trees, each in passes over the table; their number, less than ``trees`` when no more can be grown."""
        for i in range(trees):
            tree = self.grow(len(self.trees))
            if tree is None:
                return i
            self.trees.append(tree)
        return trees

    def grow_block(self, trees: int) -> int:
        """Add the next trees, grown by the task that holds all training rows; their number as in ``grow_passes``."""
        s, width, first = self.s, len(self.names), len(self.trees)
        periods = sorted({t // s.row_every for t in range(first, first + trees)})

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(np.asarray(b.column(0)), _matrix(b.column(1), width), np.asarray(b.column(2)), np.asarray(b.column(3))) for b in batches]
            if not parts:
                return
            y, margins, drawn = (np.concatenate([p[j] for p in parts]) for j in (0, 2, 3))
            bins, n = np.empty((width, len(y)), np.uint8), 0
            for p in parts:
                bins[:, n : n + len(p[0])] = p[1].T
                n += len(p[0])
            parts.clear()
            found = []
            for t in range(first, first + trees):
                rows = np.flatnonzero(drawn >> periods.index(t // s.row_every) & 1)
                tree = grown_at_hand(bins, *gradients(margins, y), rows, drawn_features(width, t, s), s)
                if tree is None:
                    break
                margins = margins + tree.margins(bins.T)
                found.append(json.dumps(asdict(tree)))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["number", "tree"])

        takes = [F.lit(True) if s.row_share >= 1 else row_draw("key", s.seed, p) < int(s.row_share * DRAWS) for p in periods]
        drawn = sum((F.when(take, 1 << i).otherwise(0) for i, take in enumerate(takes)), F.lit(0))
        train = self.table.where(~F.col("is_test")).select("y", "bins", "margin", drawn.cast("int").alias("drawn"))
        made = train.coalesce(1).mapInArrow(grow, "number int, tree string").collect()
        self.trees += [Tree(**json.loads(r["tree"])) for r in sorted(made, key=lambda r: r["number"])]
        return len(made)

    def finish_block(self) -> list[float]:
        """Store the margins with the trees since; AUC on the test rows after each of them."""
        since, width = self._since(), len(self.names)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins, margin = _matrix(b.column(3), width), np.asarray(b.column(4))
                for t in since:
                    margin = margin + t.margins(bins)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(margin)], b.schema.names)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins, margin = _matrix(b.column(1), width), np.asarray(b.column(2))
                for i, t in enumerate(since):
                    margin = margin + t.margins(bins)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * b.num_rows, pa.int32()), pa.array(margin), b.column(0)], ["round", "score", "y"])

        test = self.table.where("is_test").select("y", "bins", "margin").mapInArrow(each, "round int, score double, y int")
        aucs = auc_by(test, "round")
        self.table = stored(self.table.mapInArrow(add, "key bigint, y int, is_test boolean, bins binary, margin double"))
        self.stored_trees = len(self.trees)
        return [aucs.get(i, 0.5) for i in range(len(since))]

    def run(self) -> Model:
        aucs: list[float] = []
        while not self.one_class and len(self.trees) < self.s.rounds:
            wanted = min(BLOCK, self.s.rounds - len(self.trees))
            grown = self.grow_block(wanted) if self.at_hand else self.grow_passes(wanted)
            if grown:
                aucs += self.finish_block()
            if grown < wanted or len(aucs) - 1 - int(np.argmax(aucs)) >= self.s.patience:
                break
        aucs = stopped(aucs, self.s.patience)
        return Model(self.names, self.bounds, self.base, self.trees[: int(np.argmax(aucs)) + 1 if aucs else 0], aucs)


def stopped(aucs: list[float], patience: int) -> list[float]:
    """The rounds up to the one after which ``patience`` rounds brought no better AUC."""
    best = -1.0
    at = 0
    for i, a in enumerate(aucs):
        if a > best:
            best, at = a, i
        elif i - at >= patience:
            return aucs[: i + 1]
    return aucs


def auc_by(scored: DataFrame, by: str, buckets: int = 256) -> dict[int, float]:
    """Area under the ROC curve of each group; ties count half.

    Distinct scores are ranked inside ranges of the score, and the ranges' totals are carried on, so
    that no task ranks a whole group.
    """
    each = scored.groupBy(by, "score").agg(F.sum("y").alias("p"), (F.count(F.lit(1)) - F.sum("y")).alias("n"))
    each = each.withColumn("b", F.floor(F.lit(buckets) / (1 + F.exp(-F.col("score")))))
    inside = Window.partitionBy(by, "b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2)
    ranges = each.select(by, "b", "p", "n", won.alias("w")).groupBy(by, "b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    before = Window.partitionBy(by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` + 1 rows
    pairs = ranges.select(by, "p", "n", (F.col("w") + F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0))).alias("w"))
    rows = pairs.groupBy(by).agg((F.sum("w") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc")).collect()
    return {r[by]: 0.5 if r["auc"] is None else r["auc"] for r in rows}


def fit(rows: DataFrame, names: list[str], settings: Settings | None = None, key: str = "message_id", label: str = "y", features: str = "x", is_test: str = "is_test") -> Model:
    """Trees for ``label`` (0 or 1) from the array column ``features``, stopped by the rows of ``is_test``."""
    return Trainer(rows, names, settings or Settings(), key, label, features, is_test).run()


def score(model: Model, rows: DataFrame, features: str = "x", out: str = "score") -> DataFrame:
    """Adds the probability of class 1; null features give null."""
    width = len(model.names)

    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        given = x.notna()
        values = np.full(len(x), np.nan)
        if given.any():
            values[given] = sigmoid(model.margins(np.stack(x[given].to_list()).astype(np.float64).reshape(-1, width)))
        return pd.Series(values).where(given.to_numpy(), None)

    return rows.withColumn(out, probability(F.col(features)))


def save(model: Model, path: str, spark: SparkSession) -> None:
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Model:
    return Model.from_json(spark.read.text(path, wholetext=True).first()[0])
