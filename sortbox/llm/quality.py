"""Quality rules by host: document rules, shrunk failure rates of hosts, host verdicts.

Base counts come from whole texts (null: no words).  Four rules (``RULES``) are judged per document and
summed by host.  For each rule, the rates of all hosts give a beta prior by the method of moments: its
mean is the hosts' mean rate, its variance their variance less what sampling alone adds to it.  A host's
posterior has the mean ``(failed + m k) / (docs + k)``.  The host fails the rule if two standard
deviations below that mean still lie above the prior's upper tail (the prior's mean and two deviations,
``MAX_LIFT`` at most, and not below ``MIN_BAR``).  So few documents never fail a host, and a host like all others passes
however strict the rule is.

A document is kept if it passes the base rule and its host passes every rule.  Documents without a host
share one host.  Repeated rows count as often as they occur; an empty table gives an empty result;
columns other than the named ones are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortbox.llm import text as T
from sortbox.llm.tables import stored

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_BAR, MAX_LIFT = 0.25, 0.4
TAIL = 2.0  # standard deviations
MAX_STRENGTH = 10_000.0  # documents that the prior counts for at most
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def per_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return np.diff(c[offs])


def repeated(key: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[:-1] | same[1:]
    return out


def _lines(c: T.Chunk) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    n = len(c.buf)
    if not len(c.starts):
        return np.zeros(len(c), np.int64)
    cut = np.zeros(n + 1, bool)
    newline = np.flatnonzero(c.buf == 10)
    cut[newline + 1] = True
    cut[c.offs] = True
    begin = np.flatnonzero(cut[:n])
    line = np.searchsorted(begin, c.starts, side="right") - 1
    begin = begin[np.unique(line)]  # lines that have a word
    stop = np.minimum(np.append(newline, n)[np.searchsorted(newline, begin)], c.offs[np.searchsorted(c.offs, begin, side="right")])
    row = np.searchsorted(c.offs, begin, side="right") - 1
    up, down = T._power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(T._BYTE[c.buf] * up[:n], out=sums[1:])
    key = T.mix(T.mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64)) + row.astype(np.uint64))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return np.bincount(row[~first], minlength=len(c))


def _repeat_words(c: T.Chunk) -> np.ndarray:
    h, rows = T.rolling(c.hashes(), WINDOW), c.rows()
    if not len(h):
        return np.zeros(len(c), np.int64)
    whole = np.flatnonzero(rows[: len(h)] == rows[WINDOW - 1 :])
    twice = whole[repeated(T.mix(h[whole] + rows[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    cover = np.zeros(len(rows) + 1, np.int64)
    cover[twice] += 1
    cover[twice + WINDOW] -= 1
    return np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=len(c))


def base_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus the five counts of each text."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"{x} bigint" for x in COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in COUNTS]
            for c in T.chunks(batch.column(batch.num_columns - 1)):
                values = [np.diff(c.bounds), per_row(c.char_counts(), c.bounds), per_row(_SYMBOL[c.buf], c.offs), _lines(c), _repeat_words(c)]
                for p, v in zip(parts, values, strict=True):
                    p.append(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(np.concatenate(p).astype(np.int64)) for p in parts)], [*batch.schema.names[:-1], *COUNTS]
            )

    return rows.mapInArrow(count, schema)


def rules() -> dict[str, Column]:
    """What a document fails, from its counts.  The base rule decides on the document itself too."""
    n = F.col("n_words")
    return {
        "base": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > n,
        "letters": F.col("word_chars") < 2 * n,
    }


def prior(hosts: DataFrame, failed: str) -> tuple[float, float, float]:
    """Mean and strength (documents it counts for) of the beta prior of a rule, and the bar for hosts."""
    rate = F.col(failed) / F.col("host_docs")
    m, v, inverse = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("host_docs"))).first()
    if m is None:
        return 0.0, MAX_STRENGTH, MIN_BAR
    between = v - m * (1 - m) * inverse
    k = min(max(m * (1 - m) / between - 1, 1.0), MAX_STRENGTH) if between > 0 else MAX_STRENGTH
    return m, k, max(m + min(TAIL * (m * (1 - m) / (k + 1)) ** 0.5, MAX_LIFT), MIN_BAR)


def host_verdicts(checked: DataFrame, host: str, failing: dict[str, Column]) -> DataFrame:
    """Per host: documents, failures of each rule (``<rule>_failed``), shrunk rates (``<rule>_rate``),
    the rules it fails and whether it passes."""
    counts = [F.count_if(c).alias(f"{name}_failed") for name, c in failing.items()]
    hosts = checked.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), *counts)
    out, fails = hosts, []
    for name in failing:
        m, k, bar = prior(hosts, f"{name}_failed")
        rate = (F.col(f"{name}_failed") + m * k) / (F.col("host_docs") + k)
        spread = F.sqrt(rate * (1 - rate) / (F.col("host_docs") + k + 1))
        out = out.withColumn(f"{name}_rate", rate)
        fails.append(F.when(rate - TAIL * spread > bar, F.lit(name)))
    out = out.withColumn("host_fails", F.array_compact(F.array(*fails)))
    return out.withColumn("host_passes", F.size("host_fails") == 0)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts, own verdict, the rules that the host fails and the final verdict of every document."""
    failing = rules()
    named = docs.withColumn("host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    checked = stored(base_counts(named, ["doc_id", "host"]).withColumn("base_failed", failing["base"]), "quality")
    verdicts = host_verdicts(checked, "host", failing).select("host", "host_fails", "host_passes")
    return checked.join(verdicts, "host").withColumn("kept", ~F.col("base_failed") & F.col("host_passes"))
