"""Removal of repeated passages with prefix-partitioned suffix trees.

A passage is repeated when a window of ``WINDOW`` consecutive words starts in two documents; every
document but the one with the smallest id loses the words that such windows cover.  Windows are
judged on the input.

1. Suffixes that can matter: the least gram (``GRAM`` words) of each window is kept per document;
   equal windows have equal least grams, so a window whose least gram is in one document only cannot
   repeat.  This leaves the suffixes in copied text.
2. Each suffix carries its path in the tree: the hash of its first ``GRAM`` words and of its first
   ``WINDOW`` words.  Ranges of the path, with boundaries sampled by Spark, are prefixes of variable
   length: a rare prefix shares its range with others, a frequent one is cut at longer prefixes, so
   that ranges stay of a size.
3. Inside a range the sorted suffixes are the leaves of the subtree, in order; a run with the same
   path of ``WINDOW`` words is a deep internal node.  Its first leaf is its owner, the other leaves'
   documents lose the window.  Runs are read as a stream, so a node may have any number of leaves.

A document counts once in a node however often it holds the window.  Null text: no words.  Rows
without an id are returned unchanged and not compared; rows with the same id do not remove each
other's words, but lose the same passages.  An empty table gives an empty result; columns other than
the named ones are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortbox.llm import text as T

WINDOW = 50
GRAM = 8


def least_grams(grams: np.ndarray, span: int) -> np.ndarray:
    """Minimum over every ``span`` consecutive values."""
    done, out = 1, grams
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


class Windows:
    """The windows of a chunk that lie inside one row: number of the first word, row, path."""

    def __init__(self, c: T.Chunk, window: int, gram: int):
        words, rows = c.hashes(), c.rows()
        n = len(words) - window + 1
        inside = np.flatnonzero(rows[:n] == rows[window - 1 :]) if n > 0 else np.empty(0, np.int64)
        self.at, self.row = inside, rows[inside]
        grams = T.rolling(words, gram)
        self.least = least_grams(grams, window - gram + 1)[inside].view(np.int64) if n > 0 else np.empty(0, np.int64)
        self.prefix = (grams[inside] >> np.uint64(32)).view(np.int64)
        self.path = T.rolling(words, window)[inside].view(np.int64) if n > 0 else np.empty(0, np.int64)
        self.bounds = np.searchsorted(self.row, np.arange(len(c) + 1))


def _anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Distinct least grams of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in T.chunks(batch.column(1)):
                w = Windows(c, window, gram)
                new = np.ones(len(w.at), bool)
                new[1:] = (w.least[1:] != w.least[:-1]) | (w.row[1:] != w.row[:-1])
                row, least = w.row[new], w.least[new]
                order = np.lexsort((least, row))
                row, least = row[order], least[order]
                new = np.ones(len(row), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.lo : c.hi].take(pa.array(row[new])), pa.array(least[new])], ["doc_id", "gram"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id bigint, gram bigint")


def _suffixes(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """Distinct paths of the suffixes of each document whose window's least gram is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared = batch.column(0), batch.column(batch.num_columns - 1)
            for c in T.chunks(batch.column(1)):
                w = Windows(c, window, gram)
                for i in range(len(c)):
                    a, b = w.bounds[i], w.bounds[i + 1]
                    mine = np.isin(w.least[a:b], shared[c.lo + i].values.to_numpy())
                    path, first = np.unique(w.path[a:b][mine], return_index=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w.prefix[a:b][mine][first]), pa.array(path), pa.array(np.full(len(path), ids[c.lo + i].as_py(), np.int64))], ["prefix", "path", "doc_id"]
                    )

    return marked.mapInArrow(run, "prefix bigint, path bigint, doc_id bigint")


def deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves other than the owner's of every deep node; input sorted by prefix, path, document."""
    last: tuple[int, int, int] | None = None  # prefix, path and owner of the node that is open
    for batch in batches:
        if not batch.num_rows:
            continue
        prefix, path, doc = (x.to_numpy() for x in batch.columns)
        new = np.ones(len(doc), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (path[1:] != path[:-1])
        owner = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        if last and last[:2] == (prefix[0], path[0]):
            upto = int(new[1:].argmax()) + 1 if new[1:].any() else len(doc)
            owner[:upto] = last[2]
        last = (prefix[-1], path[-1], owner[-1])
        lose = doc > owner
        yield pa.RecordBatch.from_arrays([pa.array(doc[lose]), pa.array(path[lose])], ["doc_id", "path"])


def repeated_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(``doc_id``, ``path``): windows of each row that also start in one with a smaller id.

    ``rows`` begins with the columns ``doc_id`` (never null) and ``text``.
    """
    anchors = _anchors(rows, window, gram)
    shared = anchors.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("gram")
    marks = anchors.join(shared, "gram").groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
    # All columns of ``rows`` go on here, so that its exchange is the one that remove_repeats() has.
    leaves = _suffixes(rows.join(marks, "doc_id"), window, gram)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = leaves.repartitionByRange(parts, "prefix", "path").sortWithinPartitions("prefix", "path", "doc_id")
    return ordered.mapInArrow(deep_nodes, "doc_id bigint, path bigint")


def kept_words(c: T.Chunk, keep: np.ndarray) -> pa.Array:
    """Per row the kept words joined by one space."""
    starts, ends, row = c.starts[keep], c.ends[keep], c.rows()[keep]
    sizes = ends - starts + 1  # each with a space after it
    offs = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    at = np.repeat(starts - offs[:-1], sizes) + np.arange(offs[-1])
    out = np.append(c.buf, np.uint8(32))[at]
    out[offs[1:] - 1] = 32
    bounds = np.searchsorted(row, np.arange(len(c) + 1))
    last = np.zeros(len(out), bool)
    full = bounds[1:] > bounds[:-1]
    last[offs[bounds[1:][full]] - 1] = True
    text_offs = np.zeros(len(c) + 1, np.int64)
    np.cumsum(offs[bounds[1:]] - offs[bounds[:-1]] - full, out=text_offs[1:])
    return pa.LargeStringArray.from_buffers(len(c), pa.py_buffer(text_offs), pa.py_buffer(out[~last])).cast(pa.string())


def cut_text(c: T.Chunk, keep: np.ndarray) -> pa.Array:
    """Per row the text without the other words, each with the white space after it."""
    gone = np.flatnonzero(~keep)
    edge = np.zeros(len(c.buf) + 1, np.int64)
    row_end = c.offs[np.searchsorted(c.offs, c.starts[gone], side="right")]
    upto = np.minimum(np.append(c.starts, len(c.buf))[gone + 1], row_end)
    np.add.at(edge, c.starts[gone], 1)
    np.add.at(edge, upto, -1)
    stay = np.cumsum(edge[:-1]) == 0
    counts = np.zeros(len(c.buf) + 1, np.int64)
    np.cumsum(stay, out=counts[1:])
    return pa.LargeStringArray.from_buffers(len(c), pa.py_buffer(counts[c.offs]), pa.py_buffer(c.buf[stay])).cast(pa.string())


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, text: str = "text", window: int = WINDOW, gram: int = GRAM, whole_text: bool = False) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_removed``, removed ``spans`` (word, words) and what is kept.

    ``kept_words`` has the kept words joined by one space; with ``whole_text``, ``kept_text`` has the
    text without the removed words instead, its other white space unchanged.
    """
    keep = keep or []
    # Plain columns where nothing changes: the two joins then read one exchange of the texts.
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    named = docs.select(doc_id, F.col(text) if text == "text" else F.col(text).alias("text"), *(F.col(k).alias(f"__{k}") for k in keep))
    known = named.where("doc_id is not null")
    lost = repeated_windows(known, window, gram).groupBy("doc_id").agg(F.collect_list("path").alias("paths"))
    joined = known.join(lost, "doc_id", "left").unionByName(named.where("doc_id is null"), allowMissingColumns=True)
    joined = joined.select("doc_id", "text", "paths", *(f"__{k}" for k in keep))
    kind = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    body = "kept_text" if whole_text else "kept_words"
    names = ["doc_id", *keep, "n_words", "n_removed", "spans", body]
    schema = ", ".join(["doc_id bigint", *(f"`{k}` {kind[f'__{k}']}" for k in keep), "n_words bigint, n_removed bigint, spans array<struct<word:bigint,words:bigint>>", f"{body} string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(2)
            for c in T.chunks(batch.column(1)):
                stay = np.ones(len(c.starts), bool)
                hit = pc.is_valid(paths[c.lo : c.hi]).to_numpy(zero_copy_only=False)
                if hit.any():
                    w = Windows(c, window, gram)
                    cover = np.zeros(len(c.starts) + 1, np.int64)
                    for i in np.flatnonzero(hit).tolist():
                        a, b = w.bounds[i], w.bounds[i + 1]
                        gone = w.at[a:b][np.isin(w.path[a:b], paths[c.lo + i].values.to_numpy())]
                        cover[gone] += 1
                        cover[gone + window] -= 1
                    stay = np.cumsum(cover[:-1]) == 0
                rows = c.rows()
                n_removed = np.bincount(rows[~stay], minlength=len(c))
                # Removed runs: first word (of its row) and number of words.
                first = ~stay
                first[1:] &= stay[:-1] | (rows[1:] != rows[:-1])
                begin = np.flatnonzero(first)
                run_of = np.cumsum(first)[~stay] - 1
                words = np.bincount(run_of, minlength=len(begin))
                offs = np.searchsorted(rows[begin], np.arange(len(c) + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(begin - c.bounds[rows[begin]]), pa.array(words.astype(np.int64))], ["word", "words"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i)[c.lo : c.hi] for i in (0, *range(3, batch.num_columns))),
                        pa.array(np.diff(c.bounds).astype(np.int64)),
                        pa.array(n_removed.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offs), pairs),
                        (cut_text if whole_text else kept_words)(c, stay),
                    ],
                    names,
                )

    return joined.mapInArrow(run, schema)
