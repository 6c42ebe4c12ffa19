"""Benchmark decontamination by latent semantic retrieval.

1. Words are runs of letters and digits, case-folded and hashed to ``BUCKETS`` buckets.  Document
   frequencies of the buckets are counted over all documents; a word weighs the squared logarithm of
   its inverse document frequency.  Where a document repeats ``GRAM`` words of an item in a row
   (and over gaps of at most ``GAP`` words between such places) its words are not counted, so that
   an item keeps its weight however many documents repeat it.
2. Benchmark items are cut into passages of ``PASSAGE`` words, and these into runs of ``SPACE``.  A
   randomised SVD of a run's TF-IDF matrix (range finder with power steps; runs are dealt to tasks)
   gives its latent space.  ``RANK`` is more than ``SPACE``, so that a space holds all of its passages however
   many items there are; its first ``LATENT`` directions hold what many passages share, in which words that
   go together in the benchmark are near to each other.
3. Every document is cut into overlapping passages of the same length that cover it.  They are
   folded into the spaces and compared, in blocks, with all passages of the benchmark.  A passage's
   length holds its words outside a space as well; a passage in which the space's words make up
   less than the square of the least cosine of it cannot reach that cosine and is not folded in.
   A candidate has the least cosine in the whole space (equal words) or in its first directions
   (words that go together), so the latter only adds candidates.
4. For each candidate the words are aligned where most of the rare words agree, and the longest
   common subsequence of item and text is taken there.  Near to a whole item (``COPY``) is a leak;
   less (``PARAPHRASE``) is a leak if the answer, the item's last sentence (its last third if it has
   only one), is there by the weight of its words (``ANSWER``).  Items of less than ``SHORT`` words
   need all of their words.

Items are taken in blocks of ``ITEM_BLOCK`` by id, so that what is broadcast is bounded; all are
taken.  Null texts, and texts without words, match nothing, nor do items without an id; so does
everything when one table is empty.  An item counts once however often it is listed with the same
text; repeated documents each have their hits.  Columns other than the named ones are
neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortbox.llm import text as T
from sortbox.llm.language_id import _slices

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
GRAM = 3
GRAM_BITS = 24
GRAMS = 1 << GRAM_BITS
GAP = 4
PASSAGE = 32
STRIDE = 16
SPACE = 192
RANK = 256
LATENT = 96  # first directions of a space, fewer than its passages
POWER_STEPS = 3
COSINE = 0.35
COPY = 0.8
PARAPHRASE = 0.55
ANSWER = 0.7
SHORT = 8
ITEM_BLOCK = 2_000
WORD = re.compile(r"[^\W_]+")
HITS = "array<struct<item_id:bigint,cosine:double,lcs_share:double,answer_share:double,word:bigint>>"


@lru_cache(1)
def _word_chars() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the number of the first word of each (and the end)."""
    folded = [(t or "").casefold() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(folded) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_chars()[code]
    step = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = step[::2], step[1::2]
    up, down = T._power(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D)) * up[: len(code)], out=sums[1:])
    hashes = T.mix((sums[ends] - sums[starts]) * down[starts])
    row_begin = np.cumsum([1, *(len(t) + 1 for t in folded)])
    return hashes, np.searchsorted(starts, row_begin)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def benchmark_grams(items: DataFrame) -> np.ndarray:
    """Which of ``GRAMS`` hash values the runs of ``GRAM`` words of the items have.

    Tasks emit words of 64 bits, so at most ``GRAMS`` / 64 numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, begin = words(batch.column(0).to_pylist())
            some = np.unique(_grams(h, begin)[1]).astype(np.int64)
            bits = np.uint64(1) << (some & 63).astype(np.uint64)
            at = np.flatnonzero(np.append(True, np.diff(some >> 6) > 0)) if len(some) else some
            either = np.bitwise_or.reduceat(bits, at) if len(some) else bits
            yield pa.RecordBatch.from_arrays([pa.array(some[at] >> 6), pa.array(either.view(np.int64))], ["w", "b"])

    out = np.zeros(GRAMS // 64, np.uint64)
    for r in items.select("text").mapInArrow(run, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[r["w"]] = r["b"] & 0xFFFFFFFFFFFFFFFF
    return out


def _grams(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash value of every run of ``GRAM`` words of one text."""
    h, row = h[begin[0] : begin[-1]], np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = np.flatnonzero(row[GRAM - 1 :] == row[: len(row) - GRAM + 1]) if len(row) >= GRAM else np.empty(0, np.int64)
    return at, T.rolling(h, GRAM)[at] >> np.uint64(64 - GRAM_BITS)


def _repeats_benchmark(h: np.ndarray, begin: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which words are in a run of words of the benchmark, or in a gap between two."""
    out = np.zeros(begin[-1] - begin[0], bool)
    at, value = _grams(h, begin)
    hit = at[(grams[(value >> np.uint64(6)).astype(np.int64)] >> (value & np.uint64(63)) & np.uint64(1)).astype(bool)]
    for k in range(GRAM):
        out[hit + k] = True
    inside = np.flatnonzero(out)
    row = np.searchsorted(begin - begin[0], inside, side="right")
    step = np.where(np.diff(row) == 0, np.diff(inside), 0)
    for k in range(1, GAP + 1):
        out[inside[:-1][(step > k) & (step <= GAP + 1)] + k] = True
    return out


def document_frequencies(docs: DataFrame, text: str = "text", grams: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the number of documents.

    Words that repeat the benchmark (``grams``) are not counted.  Each task counts into one array; the arrays are summed by a grouped aggregate, so that
    ``BUCKETS`` numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for lo, hi in _slices(texts):
                h, begin = words(texts[lo:hi])
                row = np.repeat(np.arange(hi - lo), np.diff(begin))
                once = row << BUCKET_BITS | bucket(h[begin[0] : begin[-1]])
                once = np.sort(once if grams is None else once[~_repeats_benchmark(h, begin, grams)])
                once = once[np.append(True, once[1:] != once[:-1])] if len(once) else once
                total += np.bincount(once & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["b", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS, np.int64), 0
    for r in rows:
        if r["b"] < 0:
            n = r["n"]
        else:
            df[r["b"]] = r["n"]
    return df, n


def passages(n: int) -> list[tuple[int, int]]:
    """First and end word of the passages of an item of ``n`` words."""
    out = [(a, min(n, a + PASSAGE)) for a in range(0, max(1, n - PASSAGE + STRIDE), STRIDE)] if n else []
    return [*out[:-1], (max(0, n - PASSAGE), n)] if out else []


def _matrix(texts: list[str | None], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and normed TF-IDF weights of every passage."""
    h, begin = words(texts)
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        for lo, hi in passages(int(b - a)):
            at, tf = np.unique(bucket(h[a + lo : a + hi]), return_counts=True)
            w = tf * idf[at]
            out.append((at, w / max(np.linalg.norm(w), 1e-9)))
    return out


def _fit(texts: list[str | None], idf: np.ndarray, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rows = _matrix(texts, idf)
    used = np.unique(np.concatenate([np.empty(0, np.int64), *(at for at, _ in rows)]))
    if not len(used):
        return used, np.empty((0, 0), np.float32)
    m = np.zeros((len(rows), len(used)), np.float32)
    for i, (at, w) in enumerate(rows):
        m[i, np.searchsorted(used, at)] = w
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(used), min(rank, len(used)))))[0].astype(np.float32)
    for i in range(POWER_STEPS):
        full = m.T @ (m @ q)
        if i < POWER_STEPS - 1:
            q = np.linalg.qr(full)[0].astype(np.float32)
    values, turn = np.linalg.eigh((g := q.T @ full) + g.T)
    keep = values > max(values.max(), 0) * 1e-6
    return used, (q @ turn[:, keep][:, ::-1]).astype(np.float32)


def latent_spaces(runs: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Buckets of every ``run`` of texts and the right singular vectors of its passages, largest first.

    A run is one group, so runs are fitted side by side; at most its buckets times ``rank`` numbers
    of each reach the driver.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        used, vectors = _fit(group["text"].tolist(), idf, rank, seed)
        return pd.DataFrame({"run": [group["run"].iloc[0]], "used": [used.astype("<i8").tobytes()], "v": [vectors.astype("<f4").tobytes()]})

    out = {}
    for r in runs.select("run", "text").groupBy("run").applyInPandas(fit, "run bigint, used binary, v binary").collect():
        used = np.frombuffer(r["used"], "<i8")
        out[r["run"]] = used, np.frombuffer(r["v"], "<f4").reshape(len(used), -1) if len(used) else np.empty((0, 0), np.float32)
    return out


def latent_space(items: DataFrame, idf: np.ndarray, text: str = "text", rank: int = RANK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The space of all items as one run."""
    rows = items.select(F.lit(0).cast("long").alias("run"), F.col(text).alias("text"))
    return latent_spaces(rows, idf, rank, seed).get(0, (np.empty(0, np.int64), np.empty((0, 0), np.float32)))


@dataclass
class Space:
    """The latent space of a run of passages, and the passages in it."""

    slot: np.ndarray  # row of ``vectors`` of each bucket; the last row is zero
    vectors: np.ndarray
    latent: np.ndarray
    first: np.ndarray  # the passages in the first ``LATENT`` directions
    of: np.ndarray  # item of each passage


@dataclass
class Index:
    """A block of benchmark items: their words and answers, and the spaces of their passages."""

    idf: np.ndarray
    known: np.ndarray  # whether a space has the bucket
    ids: list[int]
    item_words: list[np.ndarray]
    answers: list[int]  # first word of the answer
    spaces: list[Space]


def _answer(text: str, n: int) -> int:
    """Number of the answer's first word."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if any(ch.isalnum() for ch in s)]
    if len(sentences) < 2:
        return n - max(1, n // 3)
    return n - len(words([sentences[-1]])[0])


def passage_texts(text: str | None) -> list[str]:
    """The passages of an item, each as a text."""
    own = WORD.findall((text or "").casefold())
    return [" ".join(own[lo:hi]) for lo, hi in passages(len(own))]


def space(texts: list[str], of: list[int], idf: np.ndarray, used: np.ndarray, vectors: np.ndarray) -> Space:
    slot = np.full(BUCKETS, len(used), np.int16)  # a run has at most ``SPACE`` x ``PASSAGE`` words
    slot[used] = np.arange(len(used))
    padded = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    latent = [w @ padded[slot[at]] for at, w in _matrix(texts, idf)]
    table = np.array([v / max(np.linalg.norm(v), 1e-9) for v in latent], np.float32).reshape(len(latent), vectors.shape[1])
    first = table[:, :LATENT]
    first = first / np.maximum(np.linalg.norm(first, axis=1, keepdims=True), 1e-9)
    return Space(slot, padded, table, first, np.array(of, np.int64))


def index(spark: SparkSession, rows: list[tuple[int, str | None]], idf: np.ndarray) -> Index:
    h, begin = words([t for _, t in rows])
    item_words = [h[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
    cut = [(i, p) for i, (_, t) in enumerate(rows) for p in passage_texts(t)]
    runs = [cut[lo : lo + SPACE] for lo in range(0, len(cut), SPACE)]
    spaces, known = [], np.zeros(BUCKETS, bool)
    fitted = latent_spaces(spark.createDataFrame([(k, t) for k, run in enumerate(runs) for _, t in run], "run long, text string"), idf)
    for k, run in enumerate(runs):
        used, vectors = fitted[k]
        known[used] = True
        spaces.append(space([t for _, t in run], [i for i, _ in run], idf, used, vectors))
    answers = [_answer(t or "", len(w)) for (_, t), w in zip(rows, item_words, strict=True)]
    return Index(idf.astype(np.float32), known, [r[0] for r in rows], item_words, answers, spaces)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words of ``a`` are in a longest common subsequence of ``a`` and ``b``."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        best = np.maximum(table[i + 1, :-1], np.where(b == a[i], table[i + 1, 1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = np.zeros(len(a), bool), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out[i] = True
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _check(x: Index, item: int, text: np.ndarray, lo: int, hi: int) -> tuple[float, float, int] | None:
    """LCS share, answer share and place, if words ``lo``..``hi`` of the text leak the item."""
    own = x.item_words[item]
    n = len(own)
    lo, hi = max(0, lo - n), min(len(text), hi + n)
    near = text[lo:hi]
    order = np.argsort(own, kind="stable")
    left, right = np.searchsorted(own[order], near), np.searchsorted(own[order], near, side="right")
    j = np.repeat(np.arange(len(near)), right - left)
    if not len(j):
        return None
    i = order[np.repeat(left, right - left) + np.arange(len(j)) - np.repeat(np.cumsum(right - left) - (right - left), right - left)]
    # Weight of the equal words by shift; words that the text repeats nearby count in part.
    weight = x.idf[bucket(own[i])] / np.maximum(1, (right - left)[j])
    shift = np.bincount(j - i + n, weight, minlength=n + len(near))
    slack = max(3, n // 4)
    around = np.convolve(shift, np.ones(2 * slack + 1), "same")
    if around.max() < PARAPHRASE / 2 * x.idf[bucket(own)].sum():
        return None
    at = int(around.argmax()) - n
    part = near[max(0, at - slack) : at + n + slack]
    got = common_subsequence(own, part)
    share = float(got.mean())
    if share < PARAPHRASE:
        return None
    w = x.idf[bucket(own[x.answers[item] :])] + 1e-3
    answer = float((w * got[x.answers[item] :]).sum() / w.sum())
    leak = share == 1 if n < SHORT else share >= COPY or answer >= ANSWER
    return (share, answer, lo + max(0, at)) if leak else None


def find(x: Index, texts: list[str | None]) -> list[list[tuple[int, float, float, float, int]]]:
    """Hits of every text: item, cosine, LCS share, answer share and first word, best for each item."""
    out: list[list] = [[] for _ in texts]
    h, begin = words(texts)
    if not len(h) or not x.spaces:
        return out
    at = bucket(h)
    n_words = np.diff(begin)
    n_blocks = -(-n_words // STRIDE)
    row = np.repeat(np.arange(len(texts)), n_blocks)
    nth = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    first = begin[row] + nth * STRIDE
    weight = x.idf[at]
    length = np.add.reduceat(weight * weight, first)
    shared = np.add.reduceat(np.where(x.known[at], weight * weight, 0), first)
    # A passage is a block and the next of the same text.
    own, size = shared.copy(), length.copy()
    for k in range(1, PASSAGE // STRIDE):
        same = np.flatnonzero(row[k:] == row[:-k])
        own[same] += shared[same + k]
        size[same] += length[same + k]
    fold = np.flatnonzero((own >= COSINE * COSINE * size) & (own > 0))
    if not len(fold):
        return out
    row, nth = row[fold], nth[fold]
    upto = np.minimum(first[fold] + PASSAGE, begin[row + 1])
    found: dict[tuple[int, int], float] = {}
    places: dict[tuple[int, int], list[int]] = {}
    for lo in range(0, len(fold), 2048):
        block = fold[lo : lo + 2048]
        place = first[block, None] + np.arange(PASSAGE)
        there = place < upto[lo : lo + 2048, None]
        place = np.minimum(place, len(at) - 1)
        buckets, weights = at[place], weight[place] * there
        for s in x.spaces:
            slots = s.slot[buckets]
            own = (np.where(slots < len(s.vectors) - 1, weights, 0) ** 2).sum(1)
            some = np.flatnonzero((own >= COSINE * COSINE * size[block] * (1 - 1e-4)) & (own > 0))
            vec = np.empty((len(some), s.vectors.shape[1]), np.float32)
            for k in range(0, len(some), 256):
                part = some[k : k + 256]
                vec[k : k + 256] = (weights[part][:, None, :] @ s.vectors[slots[part]])[:, 0]
            norm = np.maximum(np.sqrt(size[block[some]]), np.linalg.norm(vec, axis=1))
            cos = (vec @ s.latent.T) / norm[:, None]
            near = (vec[:, :LATENT] @ s.first.T) / norm[:, None]
            for p, q in zip(*np.nonzero(np.maximum(cos, near) >= COSINE), strict=True):
                nr = lo + int(some[p])
                key = (int(row[nr]), int(s.of[q]))
                if cos[p, q] > found.get(key, -1):
                    found[key] = float(cos[p, q])
                places.setdefault(key, []).append(nr)
    for (r, item), cos in found.items():
        text, best, done = h[begin[r] : begin[r + 1]], None, -1
        for p in sorted(set(places[r, item])):
            a = int(nth[p]) * STRIDE
            if a < done:  # the region looked at last holds it
                continue
            hit = _check(x, item, text, a, a + PASSAGE)
            done = a + (STRIDE if hit is None else PASSAGE)
            if hit and (best is None or hit[0] > best[0]):
                best = hit
                if best[0] == 1:
                    break
        if best:
            out[r].append((x.ids[item], cos, *best))
    return [sorted(v) for v in out]


def _annotate(docs: DataFrame, x: Index, names: list[str], text: str, target: str) -> DataFrame:
    rows = docs.select(*names, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{target}` {HITS}"])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64()), ("word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            hits = [h for lo, hi in _slices(texts) for h in find(x, texts[lo:hi])]
            keys = ("item_id", "cosine", "lcs_share", "answer_share", "word")
            column = pa.array([[dict(zip(keys, t, strict=True)) for t in h] for h in hits], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*batch.schema.names[:-1], target])

    return rows.mapInArrow(run, schema)


def with_hits(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every document and ``hits``, its leaks of benchmark items."""
    items = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    df, n = document_frequencies(docs, text, benchmark_grams(items))
    idf = np.log((1 + n) / (1 + df)) ** 2  # squared: rare words decide
    out, last = docs.withColumn("hits", F.expr(f"cast(array() as {HITS})")), None
    names = [*dict.fromkeys([*keep, text]), "hits"]
    while True:
        block = items if last is None else items.where((F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("text") > last[1])))
        rows = [tuple(r) for r in block.orderBy("item_id", "text").limit(ITEM_BLOCK).collect()]
        if not rows:
            break
        out = _annotate(out, index(docs.sparkSession, rows, idf), names, text, "__more").withColumn("hits", F.concat("hits", "__more")).drop("__more")
        last = rows[-1]
        if len(rows) < ITEM_BLOCK:
            break
    return out.select(*keep, "hits")
