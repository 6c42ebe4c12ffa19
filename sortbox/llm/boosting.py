"""Gradient-boosted trees in numpy: softmax loss, Newton steps, binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: split feature and bin of each inner node, values of the leaves."""

    cuts: list[np.ndarray]  # upper ends of each feature's bins
    feature: np.ndarray  # trees x (2^depth - 1)
    limit: np.ndarray
    value: np.ndarray  # trees x 2^depth
    classes: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        b, n = self.bins(x), len(x)
        flat, base = b.ravel(), np.arange(n) * b.shape[1]
        depth = (self.value.shape[1]).bit_length() - 1
        s = np.zeros((n, self.classes), np.float32)
        for t in range(len(self.feature)):
            at = np.zeros(n, np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (flat[base + self.feature[t][at]] > self.limit[t][at])
            s[:, t % self.classes] += self.value[t][at - (len(self.feature[t]))]
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, n_bins: int, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, f = b.shape
    inner = 2**depth - 1
    feature, limit = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
    at = np.zeros(n, np.int64)
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        key = (((at - first)[:, None] * f + np.arange(f)) * n_bins + b).ravel()
        sums = [np.bincount(key, np.repeat(v, f), minlength=width * f * n_bins).reshape(width, f, n_bins).cumsum(2) for v in (g, h)]
        gl, hl = sums[0][:, :, :-1], sums[1][:, :, :-1]
        gt, ht = sums[0][:, :, -1:], sums[1][:, :, -1:]
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        gain[(hl < 1) | (ht - hl < 1)] = -1
        best = gain.reshape(width, -1).argmax(1)
        ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
        feature[first : first + width] = np.where(ok, best // (n_bins - 1), 0)
        limit[first : first + width] = np.where(ok, best % (n_bins - 1), 255)
        at = 2 * at + 1 + (b[np.arange(n), feature[at]] > limit[at])
    leaf = at - inner
    value = -np.bincount(leaf, g, minlength=2**depth) / (np.bincount(leaf, h, minlength=2**depth) + ridge)
    return feature, limit, value, leaf


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.25, n_bins: int = 32, ridge: float = 2.0) -> Trees:
    cuts = [np.unique(np.quantile(x[:, i], np.arange(1, n_bins) / n_bins, method="lower"))[: n_bins - 1] for i in range(x.shape[1])]
    trees = Trees(cuts, np.empty(0), np.empty(0), np.empty(0), classes)
    b = trees.bins(x)
    score = np.zeros((len(x), classes))
    made = []
    for _ in range(rounds):
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for c in range(classes):
            g, h = p[:, c] - (y == c), np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
            feature, limit, value, leaf = _grow(b, g, h, depth, n_bins, ridge)
            score[:, c] += rate * value[leaf]
            made.append((feature, limit, (rate * value).astype(np.float32)))
    trees.feature, trees.limit, trees.value = (np.stack([m[i] for m in made]) for i in range(3))
    return trees
