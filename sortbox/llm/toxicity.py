"""Toxicity: bidirectional GRU with attention pooling over word and character inputs, in numpy.

Words are runs of letters, lower-cased.  A word's input is a word vector (hashed), the mean of the
vectors of its 3-, 5- and 7-grams with word borders (hashed), and two statistics of the training rows: the
log-odds of the word and the largest log-odds of its character grams.  Windows of ``LENGTH`` words
start every ``STRIDE`` words, so that neighbours overlap, and cover the whole text; the network gives
each a logit.  A text's score is a logistic function, fitted on rows kept out of training, of its
largest logit and the logarithm of its number of windows.

The network is fitted on at most ``SAMPLE`` rows of each label, chosen by a hash of the id.  The
first windows to learn from are those with the largest log-odds; the network then picks anew.
Null text and text without letters score the share of toxic rows among the labelled ones (0 when
there are none), as does every text when one of the labels has no row.  Several labels of a document
count as the largest.  An empty table gives an empty result; columns other than the named ones are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortbox.llm import text as T
from sortbox.llm.language_id import _letters, _slices, crc_of_id

LENGTH = 32
STRIDE = 16  # half a window: a passage of up to 17 words lies whole in one
HIDDEN = 8
WIDTH = 6  # of a word vector and of a character gram vector
WORD_BITS = 18
GRAM_BITS = 18
GRAMS = (3, 5, 7)
SAMPLE = 2000
EPOCHS = (8, 5)
BATCH = 128
SEED = 11


@dataclass
class Words:
    """Words of some texts: row of each, number of its distinct word, and hashed features of those."""

    row: np.ndarray
    number: np.ndarray
    bucket: np.ndarray  # of each distinct word
    gram: np.ndarray  # buckets of all grams of all distinct words, in order
    gram_at: np.ndarray  # where each distinct word's grams begin


def read_words(texts: list[str | None]) -> Words:
    lowered = [(t or "").lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    step = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = step[::2], step[1::2]
    up, down = T._power(len(code) + 1)
    value = T.mix(code.astype(np.uint64) + np.uint64(1))
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(value * up[: len(code)], out=sums[1:])
    hashes = T.mix((sums[ends] - sums[starts]) * down[starts])
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    row_ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    row = np.searchsorted(row_ends, starts - 1, side="right")
    # Letters of the distinct words, each word between two borders.
    sizes = (ends - starts)[first] + 2
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    flat = np.repeat(starts[first] - 1 - at[:-1], sizes) + np.arange(at[-1])
    own = value[flat]
    own[at[:-1]] = own[at[1:] - 1] = np.uint64(0x1F3D5B79)
    word = np.repeat(np.arange(len(sizes)), sizes)
    grams, words = [], []
    for n in GRAMS:
        h = T.rolling(own, n)
        inside = word[: len(h)] == word[n - 1 :] if len(h) else np.empty(0, bool)
        grams.append((h[inside] >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
        words.append(word[: len(h)][inside])
    gram, of = np.concatenate(grams), np.concatenate(words)
    order = np.argsort(of, kind="stable")
    return Words(row, number, (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64), gram[order], np.searchsorted(of[order], np.arange(len(sizes))))


def windows(w: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of every window; the last window of a row ends with the row or beyond."""
    bounds = np.searchsorted(w.row, np.arange(rows + 1))
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - LENGTH) // STRIDE)), 0)
    row = np.repeat(np.arange(rows), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return bounds[row] + nth * STRIDE, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    base: float
    lo_word: np.ndarray = field(default_factory=lambda: np.zeros(1 << WORD_BITS, np.float32))
    lo_gram: np.ndarray = field(default_factory=lambda: np.zeros(1 << GRAM_BITS, np.float32))
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def inputs(self, w: Words) -> np.ndarray:
        """Input of each distinct word, and a row of zeros for places beyond the text."""
        n = len(w.bucket)
        x = np.zeros((n + 1, 2 * WIDTH + 2), np.float32)
        if n:
            size = np.diff(np.append(w.gram_at, len(w.gram)))[:, None]
            x[:n, :WIDTH] = self.p["word"][w.bucket]
            x[:n, WIDTH : 2 * WIDTH] = np.add.reduceat(self.p["gram"][w.gram], w.gram_at) / size
            x[:n, -2] = self.lo_word[w.bucket]
            x[:n, -1] = np.maximum.reduceat(self.lo_gram[w.gram], w.gram_at)
        return x


def places(w: Words, begin: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distinct word at each place of each window (place first); the zero row beyond the text."""
    at = begin[None, :] + np.arange(LENGTH)[:, None]
    ok = at < len(w.row)
    at = np.minimum(at, len(w.row) - 1)
    return np.where(ok & (w.row[at] == row[None, :]), w.number[at], len(w.bucket))


def _run(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, pad: int, keep: bool) -> tuple[np.ndarray, list, list]:
    """Hidden states (place, window, 2 x HIDDEN) of both directions; ``keep`` what backward needs."""
    steps, n = ids.shape
    h_all = np.empty((steps, n, 2 * HIDDEN), np.float32)
    traces: list[list] = [[], []]
    for d, name in enumerate("fb"):
        gates = x @ p[f"w{name}"] + p[f"b{name}"]
        u_zr, u_h = p[f"u{name}"][:, : 2 * HIDDEN], p[f"u{name}"][:, 2 * HIDDEN :]
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g = gates[ids[t]]
            zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ u_zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u_h)
            z = z * (ids[t] != pad)[:, None]  # beyond the text the state stays
            new = h + z * (c - h)
            if keep:
                traces[d].append((t, h, z, r, c))
            h = new
            h_all[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
    return h_all, *traces


def _pool(p: dict[str, np.ndarray], h: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
    a = np.tanh(h @ p["wa"] + p["ba"])
    s = np.where(real, a @ p["va"], -1e9)
    e = np.exp(s - s.max(0))
    alpha = e / e.sum(0)
    ctx = (alpha[..., None] * h).sum(0)
    return ctx @ p["wo"] + p["bo"][0], ctx, alpha, a


def logits(m: Model, w: Words, begin: np.ndarray, row: np.ndarray, size: int = 4096) -> np.ndarray:
    x, pad = m.inputs(w), len(w.bucket)
    out = np.empty(len(begin), np.float32)
    for lo in range(0, len(begin), size):
        ids = places(w, begin[lo : lo + size], row[lo : lo + size])
        out[lo : lo + size] = _pool(m.p, _run(m.p, x, ids, pad, False)[0], ids != pad)[0]
    return out


def gradients(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, pad: int, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the weighted cross-entropy for the parameters and for ``x``."""
    h_all, *traces = _run(p, x, ids, pad, True)
    real = ids != pad
    logit, ctx, alpha, a = _pool(p, h_all, real)
    prob = _sigmoid(logit)
    loss = float((weight * np.logaddexp(0, np.where(y > 0, -logit, logit))).sum() / weight.sum())
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
    dlogit = (weight * (prob - y) / weight.sum()).astype(np.float32)
    g["wo"], g["bo"][0] = ctx.T @ dlogit, dlogit.sum()
    dctx = dlogit[:, None] * p["wo"]
    dh = alpha[..., None] * dctx
    dalpha = (h_all * dctx).sum(-1)
    ds = alpha * (dalpha - (alpha * dalpha).sum(0))
    g["va"] = np.tensordot(ds, a, ([0, 1], [0, 1]))
    da = ds[..., None] * p["va"] * (1 - a * a)
    g["wa"], g["ba"] = np.tensordot(h_all, da, ([0, 1], [0, 1])), da.sum((0, 1))
    dh = dh + da @ p["wa"].T
    dx = np.zeros_like(x)
    for d, name in enumerate("fb"):
        u_zr, u_h = p[f"u{name}"][:, : 2 * HIDDEN], p[f"u{name}"][:, 2 * HIDDEN :]
        dgates = np.zeros((len(x), 3 * HIDDEN), np.float32)
        carry = np.zeros((ids.shape[1], HIDDEN), np.float32)
        for t, h, z, r, c in reversed(traces[d]):
            total = carry + dh[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            dc = total * z * (1 - c * c)
            dz = total * (c - h) * z * (1 - z) * real[t][:, None]
            drh = dc @ u_h.T
            dzr = np.concatenate([dz, drh * h * r * (1 - r)], 1)
            carry = total * (1 - z) + drh * r + dzr @ u_zr.T
            full = np.concatenate([dzr, dc], 1)
            np.add.at(dgates, ids[t], full)
            g[f"u{name}"][:, : 2 * HIDDEN] += h.T @ dzr
            g[f"u{name}"][:, 2 * HIDDEN :] += (r * h).T @ dc
        g[f"w{name}"], g[f"b{name}"] = x.T @ dgates, dgates.sum(0)
        dx += dgates @ p[f"w{name}"].T
    return g, dx, loss


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    wide = 2 * WIDTH + 2

    def draw(*shape: int, by: float) -> np.ndarray:
        return (rng.standard_normal(shape) * by).astype(np.float32)

    p = {"word": draw(1 << WORD_BITS, WIDTH, by=0.05), "gram": draw(1 << GRAM_BITS, WIDTH, by=0.1)}
    for name in "fb":
        p |= {f"w{name}": draw(wide, 3 * HIDDEN, by=wide**-0.5), f"u{name}": draw(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), f"b{name}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"wa": draw(2 * HIDDEN, HIDDEN, by=0.3), "ba": np.zeros(HIDDEN, np.float32), "va": draw(HIDDEN, by=0.3), "wo": draw(2 * HIDDEN, by=0.3), "bo": np.zeros(1, np.float32)}


def _log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, prior: float = 2.0) -> np.ndarray:
    """Smoothed log-odds by the numbers of toxic and other rows that have a bucket."""
    share = n_pos / (n_pos + n_neg)
    value = np.log((pos + prior * share) / (n_pos + prior)) - np.log((neg + prior * (1 - share)) / (n_neg + prior))
    return np.where(pos + neg > 0, value, 0).astype(np.float32)


def _count(total: np.ndarray, row: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> None:
    """Add, by label, in how many rows each bucket occurs."""
    pairs = np.unique(row * total.shape[1] + bucket)
    for label in (0, 1):
        total[label] += np.bincount(pairs[y[pairs // total.shape[1]] == label] % total.shape[1], minlength=total.shape[1])


def train(texts: list[str | None], labels: list[int], base: float, seed: int = SEED, epochs: tuple[int, ...] = EPOCHS) -> Model:
    """Fit on four fifths of the rows, fit the score's scale on the rest.

    Texts are read in slices, so that memory holds the words of the chosen windows only.
    """
    y = np.array(labels, np.int64)
    m = Model(base)
    if not len(y) or y.min() == y.max():
        return m
    rng = np.random.default_rng(seed)
    m.p = _start(rng)
    learn = np.ones(len(y), bool)
    learn[np.arange(len(y)) % 5 == 4] = False
    parts = list(_slices(texts))
    word_rows, gram_rows = np.zeros((2, 1 << WORD_BITS), np.int64), np.zeros((2, 1 << GRAM_BITS), np.int64)
    for lo, hi in parts:
        w = read_words(texts[lo:hi])
        mine = learn[lo:hi][w.row]
        if not mine.any():
            continue
        pairs = np.unique(w.row[mine] * len(w.bucket) + w.number[mine])
        word, of = pairs % len(w.bucket), pairs // len(w.bucket)
        _count(word_rows, of, w.bucket[word], y[lo:hi])
        size = np.diff(np.append(w.gram_at, len(w.gram)))[word]
        flat = np.repeat(w.gram_at[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        _count(gram_rows, np.repeat(of, size), w.gram[flat], y[lo:hi])
    n_pos, n_neg = int(y[learn].sum()), int((1 - y[learn]).sum())
    if not n_pos or not n_neg or not word_rows.any():
        m.p = {}
        return m
    m.lo_word, m.lo_gram = _log_odds(word_rows[1], word_rows[0], n_pos, n_neg), _log_odds(gram_rows[1], gram_rows[0], n_pos, n_neg)

    def hint(w: Words, begin: np.ndarray, row: np.ndarray) -> np.ndarray:
        return m.inputs(w)[:, -2:].max(1)[places(w, begin, row)].max(0)

    adam: dict[str, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items() if k not in ("word", "gram")}
    seen = {k: np.full(len(m.p[k]), 1e-6, np.float32) for k in ("word", "gram")}
    t = 0
    for rounds, rank in zip(epochs, [hint, *[lambda *a: logits(m, *a)] * (len(epochs) - 1)], strict=True):
        w, ids_all, target = _chosen(texts, y, learn, parts, rank, rng)
        weight = (np.where(target > 0, (target == 0).sum() / max(1, (target > 0).sum()), 1.0) ** 0.5).astype(np.float32)
        pad = len(w.bucket)
        for _ in range(rounds):
            shuffled = rng.permutation(len(target))
            for lo in range(0, len(target), BATCH):
                b = shuffled[lo : lo + BATCH]
                used, inverse = np.unique(ids_all[:, b], return_inverse=True)
                words = used[used < pad]
                part = _subset(w, words)
                x = m.inputs(part)
                g, dx, _ = gradients(m.p, x, inverse.reshape(LENGTH, -1), len(words), target[b], weight[b])
                t += 1
                for k, v in g.items():
                    m1, m2 = adam[k]
                    m1 += 0.1 * (v - m1)
                    m2 += 0.001 * (v * v - m2)
                    m.p[k] -= 0.01 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
                size = np.diff(np.append(part.gram_at, len(part.gram)))
                for k, at, grad in (("word", part.bucket, dx[: len(words), :WIDTH]), ("gram", part.gram, np.repeat(dx[: len(words), WIDTH : 2 * WIDTH] / size[:, None], size, 0))):
                    rows, back = np.unique(at, return_inverse=True)
                    total = np.zeros((len(rows), WIDTH), np.float32)
                    np.add.at(total, back, grad)
                    seen[k][rows] += (total * total).mean(1)
                    m.p[k][rows] -= 0.02 * total / np.sqrt(seen[k][rows])[:, None]
    best, count = np.full(len(y), -np.inf), np.zeros(len(y), np.int64)
    for lo, hi in parts:
        w = read_words(texts[lo:hi])
        begin, row = windows(w, hi - lo)
        if len(begin):
            np.maximum.at(best, row + lo, logits(m, w, begin, row))
            count[lo:hi] = np.bincount(row, minlength=hi - lo)
    check = ~learn & (count > 0)
    if y[check].min(initial=1) < y[check].max(initial=0):
        m.scale = _fit_scale(best[check], np.log(count[check]), y[check], base)
    return m


def _chosen(texts: list[str | None], y: np.ndarray, learn: np.ndarray, parts: list[tuple[int, int]], rank, rng: np.random.Generator) -> tuple[Words, np.ndarray, np.ndarray]:
    """Windows to learn from: the strongest of each row, and a few at random of rows that are not toxic."""
    out, ids, target, n_words, n_grams = [], [], [], 0, 0
    for lo, hi in parts:
        w = read_words(texts[lo:hi])
        begin, row = windows(w, hi - lo)
        if not len(begin):
            continue
        order = np.lexsort((-rank(w, begin, row), row))
        nth = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        label = y[lo:hi][row[order]]
        take = np.where(label > 0, nth < 1, (nth < 2) | (rng.random(len(row)) < 0.03)) & learn[lo:hi][row[order]]
        chosen = order[take]
        used, inverse = np.unique(places(w, begin[chosen], row[chosen]), return_inverse=True)
        words = used[used < len(w.bucket)]
        inverse = inverse.reshape(LENGTH, -1)
        part = _subset(w, words)
        ids.append(np.where(inverse < len(words), inverse + n_words, -1))
        target.append(label[take])
        out.append((part.bucket, part.gram, part.gram_at + n_grams))
        n_words, n_grams = n_words + len(words), n_grams + len(part.gram)
    all_ids = np.concatenate(ids, 1)
    none = np.empty(0, np.int64)
    return Words(none, none, *(np.concatenate(v) for v in zip(*out, strict=True))), np.where(all_ids < 0, n_words, all_ids), np.concatenate(target).astype(np.float32)


def _subset(w: Words, words: np.ndarray) -> Words:
    size = np.diff(np.append(w.gram_at, len(w.gram)))[words]
    at = np.cumsum(size) - size
    flat = np.repeat(w.gram_at[words] - at, size) + np.arange(size.sum())
    return Words(w.row, w.number, w.bucket[words], w.gram[flat], at)


def _fit_scale(x: np.ndarray, n: np.ndarray, y: np.ndarray, base: float) -> tuple[float, float, float]:
    """Logistic fit by damped Newton steps; rows weigh as the labels do among all labelled rows."""
    f = np.stack([np.clip(x, -15, 15), n, np.ones_like(x)], 1).astype(np.float64)
    weight = np.where(y > 0, base / max(y.mean(), 1e-9), (1 - base) / max(1 - y.mean(), 1e-9))
    start, pull = np.array([1.0, 0.0, 0.0]), np.diag([1.0, 4.0, 0.05])

    def loss(c: np.ndarray) -> float:
        v = f @ c
        return float((weight * (np.logaddexp(0, v) - y * v)).sum() + 0.5 * (c - start) @ pull @ (c - start))

    c = start
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(f @ c, -30, 30)))
        grad = f.T @ (weight * (q - y)) + pull @ (c - start)
        step = np.linalg.solve((f * (weight * q * (1 - q))[:, None]).T @ f + pull, grad)
        size = 1.0
        while size > 1e-4 and loss(c - size * step) > loss(c):
            size /= 2
        c = c - size * step
        if size * np.abs(step).max() < 1e-6:
            break
    return float(max(c[0], 1e-3)), float(c[1]), float(c[2])


def score_texts(m: Model, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), m.base)
    for lo, hi in _slices(texts) if m.p else ():
        w = read_words(texts[lo:hi])
        begin, row = windows(w, hi - lo)
        if not len(begin):
            continue
        best = np.full(hi - lo, -np.inf)
        np.maximum.at(best, row, logits(m, w, begin, row))
        count = np.bincount(row, minlength=hi - lo)
        has = count > 0
        a, b, c = m.scale
        value = a * best[has] + b * np.log(count[has]) + c
        out[lo:hi][has] = 1 / (1 + np.exp(-np.clip(value, -30, 30)))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each label."""
    truth = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {int(r[0]): r[1] for r in truth.groupBy((F.col("y") > 0).cast("int")).agg(F.count("*")).collect()}
    total = sum(counts.values())
    order = F.xxhash64("doc_id")
    parts = [truth.where((F.col("y") > 0) == F.lit(bool(v))).orderBy(order, "doc_id").limit(sample) for v in (0, 1)]
    # At most 2 x ``sample`` ids.
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select("doc_id", F.col(text).alias("text")).join(chosen, "doc_id").select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] for r in rows], [r["y"] for r in rows], counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the ``score`` of each whole text."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = score_texts(model, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value, pa.float64())], [*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, schema)


def held_out(name: str = "doc_id"):
    return F.coalesce(crc_of_id(name) % 4 == 2, F.lit(True))
