"""Hierarchical packing of tokenised documents into sequences.

A document's ids are cut into whole long windows and a rest.  The rest is routed to the smallest
context size (tier) that holds it.  From the longest tier down, each rest opens a window of its
tier; the window's gap is filled with the largest shorter rests that fit, and what then remains with
a piece cut from a shorter rest.  Windows are therefore exactly full.  What is left at the end of a
task is cut at powers of two.  Sequences are dealt to step groups of about ``STEP_TOKENS`` tokens,
longest first in alternating order, so that groups hold like amounts of each length.

Tokenising and packing happen in the same task on blocks of bounded size; no ids are shuffled.
A document's ids are held whole by its task, whatever its length.  Null text counts as empty (only the end id).  Repeated rows are packed as often as they occur.  An
empty table gives an empty result; columns other than the named ones are neither read nor returned.
A sequence's number holds the task's partition and a running number, so a task that runs again
gives the same numbers.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
END_ID = 1
BLOCK_TOKENS = 1_000_000
STEP_TOKENS = 65_536
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, "
    "sequence_length bigint, tier int, step bigint"
)
Piece = tuple[int, int, int]  # document of the block, first id, number of ids


@lru_cache(2)
def tokenizer(path: str | None = None):
    """Byte-level BPE of a ``tokenizers`` file, run by tiktoken (same ids, several times as fast)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = json.load(f)
    # Byte-level files write the printable bytes as themselves and the others from U+0100 up.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    decode = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(decode[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(2)
def library(path: str | None = None, added: bool = False):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = not added
    return out


def encode(text: str, path: str | None = None, added: bool = False) -> list[int]:
    """Ids of a text; a run of white space that is too long for tiktoken's pattern goes to ``tokenizers``."""
    try:
        return tokenizer(path).encode(text, allowed_special="all" if added else set(), disallowed_special=())
    except ValueError as e:
        if "backtracking" not in str(e):
            raise
        return library(path, added).encode(text, add_special_tokens=False).ids


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences (lists of pieces) over documents of these lengths; if not ``last``, the rest too."""
    return pack_pieces([(d, 0, n) for d, n in enumerate(lengths)], tiers, last)


def pack_pieces(pieces: list[Piece], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    top, sequences, rests = tiers[-1], [], []
    for d, start, n in pieces:
        while n >= top:
            sequences.append([(d, start, top)])
            start, n = start + top, n - top
        if n:
            rests.append((n, d, start))
    rests.sort()
    while rests:
        n, d, start = rests.pop()  # the longest rest opens a window of its tier
        tier = next(t for t in tiers if t >= n)
        window, gap = [(d, start, n)], tier - n
        while gap and rests:
            i = bisect_right(rests, (gap, float("inf"), 0))
            if i:
                n, d, start = rests.pop(i - 1)
                window.append((d, start, n))
            else:  # every rest is longer than the gap: cut the shortest
                n, d, start = rests.pop(0)
                window.append((d, start, gap))
                insort(rests, (n - gap, d, start + gap))
                n = gap
            gap -= n
        if not gap:
            sequences.append(window)
        elif not last:
            return sequences, window
        else:
            sequences += cut_at_powers(window)
    return sequences, []


def cut_at_powers(window: list[Piece]) -> list[list[Piece]]:
    """Cut a window that is not full into sequences whose lengths are powers of two."""
    left, out, window = sum(n for _, _, n in window), [], list(window)
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        sequence: list[Piece] = []
        while size:
            d, start, n = window.pop(0)
            take = min(n, size)
            sequence.append((d, start, take))
            size -= take
            if take < n:
                window.insert(0, (d, start + take, n - take))
        out.append(sequence)
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Group of each sequence: dealt longest first, forwards and backwards in turn."""
    groups = max(1, -(-sum(sizes) // step_tokens))
    out = [0] * len(sizes)
    for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        turn, at = divmod(k, groups)
        out[i] = at if turn % 2 == 0 else groups - 1 - at
    return out


def pack_documents(docs: DataFrame, text: str = "text", path: str | None = None, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, added: bool = False) -> DataFrame:
    """One row per piece: its document, place, checksum, sequence, place there, tier and step.

    With ``added`` the file's added tokens have their own ids where a text holds them, as in a plain
    ``tokenizers`` call; without, they are split as any text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        ids: list[np.ndarray] = []  # of the block's documents
        names: list[int | None] = []
        carried: list[Piece] = []
        fresh, tokens, sequence, step = 0, 0, 0, 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal ids, names, carried, fresh, tokens, sequence, step
            made, rest = pack_pieces(carried + [(d, 0, len(ids[d])) for d in range(fresh, len(ids))], tiers, last)
            groups = step_groups(sizes := [sum(p[2] for p in s) for s in made])
            rows = []
            for s, size, g in zip(made, sizes, groups, strict=True):
                tier, offset = next((t for t in tiers if t >= size), tiers[-1]), 0
                for d, start, n in s:
                    crc = zlib.crc32(ids[d][start : start + n].tobytes())
                    rows.append((names[d], start, n, crc, len(ids[d]), base + sequence, offset, size, tier, base + step + g))
                    offset += n
                sequence += 1
            step += max(groups, default=-1) + 1
            used = sorted({d for d, _, _ in rest})
            number = {d: i for i, d in enumerate(used)}
            carried = [(number[d], start, n) for d, start, n in rest]
            ids, names = [ids[d] for d in used], [names[d] for d in used]
            fresh, tokens = len(ids), 0
            columns = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0].strip("`") for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(np.array([*encode(value.as_py() or "", path, added), END_ID], "<u4"))
                names.append(doc_id)
                tokens += len(ids[-1])
                if tokens >= block_tokens:
                    yield flush(False)
        yield flush(True)

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, SCHEMA)
