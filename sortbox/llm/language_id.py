"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram binds three of them: the first
permuted twice, the second once, the third as it is, multiplied element by element.  A text, and a
language, is the bundle (sum) of its trigram vectors; a text gets the language whose prototype has
the largest cosine with it.

Letters are lower-cased; whatever is not a letter ends a word, and a word's first and last trigram
hold the border.  Null or letterless text gives ``und`` with score 0; so does any text when
there is no labelled row to learn from.  Equal cosines go to the first language in sort order.
A text of any length is read whole; texts are scored in slices of about ``CHUNK_CHARS`` characters, one
text when it is longer.  Repeated rows are scored alike, an empty table gives an empty result, and columns other than the
named ones are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 512
SEED = 7
SHARPNESS = 40.0
UNKNOWN = "und"
MAX_TABLE = 4_000_000  # dense trigram numbering up to this many codes, sorting beyond
CHUNK_CHARS = 1 << 19
MAX_DENSE = 2_000_000  # cells of a dense table of texts by trigrams
MAX_BOUND = 1 << 14  # trigrams that are bound at once


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """A fixed +-1 vector for each code point (0 is the word border)."""
    out = np.empty((len(codes), dim), np.int8)
    for i, code in enumerate(codes.tolist()):
        out[i] = np.random.default_rng((seed, code)).integers(0, 2, dim) * 2 - 1
    return out


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the alphabet, alphabet numbers of each trigram (n x 3) and its text."""
    lowered = [(t or "").lower() for t in texts]
    joined = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[joined]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    where = np.flatnonzero(keep)
    code = np.where(letter[where], joined[where], 0)
    mid = np.flatnonzero(code[1:-1]) + 1
    if not len(mid):
        return np.zeros(1, np.int64), np.empty((0, 3), np.int64), np.empty(0, np.int64)
    seen = np.bincount(code)
    alphabet = np.flatnonzero(seen)
    number = np.zeros(len(seen), np.int64)
    number[alphabet] = np.arange(len(alphabet))
    n = number[code]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    return alphabet, np.stack([n[mid - 1], n[mid], n[mid + 1]], 1), np.searchsorted(ends, where[mid] - 1, side="right")


def counted(alphabet: np.ndarray, tri: np.ndarray, group: np.ndarray, groups: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each distinct trigram in each group, and the bound vectors of those trigrams."""
    a = len(alphabet)
    codes = (tri[:, 0] * a + tri[:, 1]) * a + tri[:, 2]
    if a**3 <= MAX_TABLE:
        distinct = np.flatnonzero(np.bincount(codes, minlength=1))
        table = np.zeros(distinct[-1] + 1, np.int64)
        table[distinct] = np.arange(len(distinct))
        at = table[codes]
    else:
        distinct, at = np.unique(codes, return_inverse=True)
    counts = np.bincount(group * len(distinct) + at, minlength=groups * len(distinct)).reshape(groups, -1)
    own = letter_vectors(alphabet, dim, seed)
    first, second, third = distinct // (a * a), distinct // a % a, distinct % a
    bound = np.roll(own, 2, 1)[first] * np.roll(own, 1, 1)[second] * own[third]
    return counts, bound


def bundles(alphabet: np.ndarray, tri: np.ndarray, group: np.ndarray, groups: int, dim: int, seed: int) -> np.ndarray:
    """Sum of the bound vectors of all trigrams of each group.

    Few distinct trigrams are counted in a dense table; else (group, trigram) pairs are counted and
    bound ``MAX_BOUND`` at a time, so memory does not grow with the alphabet or its cube.
    """
    a = len(alphabet)
    codes = (tri[:, 0] * a + tri[:, 1]) * a + tri[:, 2]
    if a**3 <= MAX_BOUND or len(distinct := np.unique(codes)) <= min(MAX_BOUND, MAX_DENSE // groups):
        counts, bound = counted(alphabet, tri, group, groups, dim, seed)
        return (counts.astype(np.float32) @ bound.astype(np.float32)).astype(np.int64)
    own = letter_vectors(alphabet, dim, seed)
    twice, once = np.roll(own, 2, 1), np.roll(own, 1, 1)
    pairs, counts = np.unique(group * len(distinct) + np.searchsorted(distinct, codes), return_counts=True)
    of_group, codes = pairs // len(distinct), distinct[pairs % len(distinct)]
    out = np.zeros((groups, dim), np.int64)
    for lo in range(0, len(pairs), MAX_BOUND):
        code, g = codes[lo : lo + MAX_BOUND], of_group[lo : lo + MAX_BOUND]
        bound = (twice[code // (a * a)] * once[code // a % a] * own[code % a]) * counts[lo : lo + MAX_BOUND, None].astype(np.int32)
        starts = np.flatnonzero(np.diff(g, prepend=-1))
        out[g[starts]] += np.add.reduceat(bound, starts, axis=0)
    return out


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS or i - lo >= 1000:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype of each language: the bundle of the trigrams of all its labelled texts.

    Each task sums integer bundles; the sums over tasks are a grouped aggregate, so that only
    languages x ``dim`` numbers reach the driver.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                names = sorted(set(langs[lo:hi]))
                alphabet, tri, row = trigrams(texts[lo:hi])
                if not len(tri):
                    continue
                number = {x: i for i, x in enumerate(names)}
                group = np.array([number[x] for x in langs[lo:hi]])[row]
                sums = bundles(alphabet, tri, group, len(names), dim, seed)
                for i, x in enumerate(names):
                    total[x] = total.get(x, 0) + sums[i]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "v"]
        )

    sums = (
        rows.mapInArrow(bundle, "lang string, v array<bigint>")
        .select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
        .collect()
    )
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["x"]
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text: str = "text", seed: int = SEED) -> DataFrame:
    """``keep`` columns plus ``lang_pred`` and ``score``, the softmax of the cosines at ``SHARPNESS``."""
    names = list(prototypes)
    table = np.stack([prototypes[x] for x in names]).astype(np.float32) if names else np.zeros((0, DIM), np.float32)
    dim = table.shape[1]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "score double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            pred, prob = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo, hi in _slices(texts) if names else ():
                alphabet, tri, row = trigrams(texts[lo:hi])
                if not len(tri):
                    continue
                v = bundles(alphabet, tri, row, hi - lo, dim, seed).astype(np.float32)
                cos = (v @ table.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                soft = np.exp(SHARPNESS * (cos - cos.max(1, keepdims=True)))
                soft /= soft.sum(1, keepdims=True)
                best = cos.argmax(1)
                for i in np.unique(row).tolist():
                    pred[lo + i], prob[lo + i] = names[best[i]], soft[i, best[i]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(prob)], [*batch.schema.names[:-1], "lang_pred", "score"]
            )

    return rows.mapInArrow(score, schema)


def crc_of_id(name: str = "doc_id"):
    """crc32 of the id as text."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learn from labelled rows whose id's crc32 mod 5 is not 0 (a null id is held out), predict all."""
    held = F.coalesce(crc_of_id() % 5 == 0, F.lit(True))
    prototypes = fit(docs.where(~held))
    return predict(docs.withColumn("held_out", held), prototypes, [*(keep or ["doc_id"]), "held_out"])
