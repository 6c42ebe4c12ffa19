"""Fill-in-the-middle transformation with a piece table.

A document is a list of descriptors (buffer, start, end) over two immutable buffers: its own text and
the sentinels.  Cutting splits descriptors, an arrangement permutes them, the inverse permutation
restores them, and hashes read the described bytes in order; no text is copied before the result is
written.  ``transform`` gives the arranged text, ``restore`` rebuilds the exact text from that and its
form alone.

A document is cut at two of the bounds of its units, lines or characters.  The cuts, whether a
document is changed at all, and its form follow from sha256 of ``seed:doc_id``, so they do not depend
on partitions or on a task that runs again.  A text that is empty, or that holds a sentinel, stays
plain.

Null text counts as empty, a null id as no digits.  Repeated rows are transformed as often as they
occur, all alike.  An empty table gives an empty result.  Texts of any length are one buffer each;
results leave a task in batches of about ``BATCH_BYTES`` (one row when a text is longer).  Columns of
the input other than the id, the text and those of ``keep`` are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
TEXT, SENTINEL = 0, 1  # buffers
# Parts of a cut document, in the order in which they are described: prefix, middle, suffix, then the
# sentinels of prefix, suffix and middle.  A form names the part at each place.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
BATCH_BYTES = 8 << 20
Piece = tuple[int, int, int]  # buffer, first byte, byte after the last


class PieceTable:
    """Descriptors over immutable buffers; every operation gives a new table over the same buffers."""

    def __init__(self, buffers: Sequence[bytes | memoryview], pieces: Sequence[Piece]):
        self.buffers = tuple(memoryview(b) for b in buffers)
        self.pieces = tuple(pieces)

    def __len__(self) -> int:
        return sum(end - start for _, start, end in self.pieces)

    def cut(self, piece: int, ends: Sequence[int]) -> PieceTable:
        """Split one descriptor at these places of its buffer (ascending, inside the piece)."""
        buffer, start, end = self.pieces[piece]
        bounds = [start, *ends, end]
        parts = [(buffer, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
        return PieceTable(self.buffers, [*self.pieces[:piece], *parts, *self.pieces[piece + 1 :]])

    def arrange(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def take(self, n: int) -> PieceTable:
        """The first ``n`` descriptors."""
        return PieceTable(self.buffers, self.pieces[:n])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            yield self.buffers[buffer][start:end]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()


def inverse(order: Sequence[int]) -> list[int]:
    """The permutation that undoes ``order``."""
    out = [0] * len(order)
    for place, part in enumerate(order):
        out[part] = place
    return out


def line_ends(text: np.ndarray) -> np.ndarray:
    """The byte after each line; the last line may lack its line feed."""
    ends = np.flatnonzero(text == 10) + 1
    return ends if not len(text) or text[-1] == 10 else np.append(ends, len(text))


def character_ends(text: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero((text & 0xC0) != 0x80)
    return np.append(starts[1:], len(text)) if len(text) else starts


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"line": line_ends, "character": character_ends}


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers that only the seed and the id decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def split(text: bytes, doc_id: int | None, unit: str, rate: int, spm_rate: int, seed: int, sentinels: Sequence[bytes]) -> tuple[int, str, PieceTable]:
    """Units, form and parts of a text; the parts of a plain one are the text alone."""
    ends = UNITS[unit](np.frombuffer(text, np.uint8))
    a, b, share, side = draws(doc_id, seed)
    n = len(ends)
    marks = b"".join(sentinels)
    table = PieceTable((text, marks), [(TEXT, 0, len(text))])
    if not text or any(s in text for s in sentinels) or share % 100 >= rate:
        return n, "plain", table
    first, second = sorted((a % (n + 1), b % (n + 1)))
    places = [int(ends[k - 1]) if k else 0 for k in (first, second)]
    at, described = 0, []
    for s in sentinels:
        described.append((SENTINEL, at, at + len(s)))
        at += len(s)
    cut = table.cut(0, places)
    return n, "spm" if side % 100 < spm_rate else "psm", PieceTable(cut.buffers, [*cut.pieces, *described])


def parts_of(output: bytes, form: str, sentinels: Sequence[bytes]) -> PieceTable:
    """The parts of an arranged text, in the order in which they were described before."""
    table = PieceTable((output,), [(TEXT, 0, len(output))])
    if form == "plain":
        return table
    places, at = [], 0
    for part in ARRANGEMENTS[form]:
        if part >= 3:  # a sentinel: no text that was changed holds one
            at = output.index(sentinels[part - 3], at)
            places += [at, at + len(sentinels[part - 3])]
    return table.cut(0, places[1:]).arrange(inverse(ARRANGEMENTS[form]))


def code_points(part: memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def _in_batches(df: DataFrame, schema: str, row: Callable[[dict], tuple[tuple, int]]) -> DataFrame:
    """Apply ``row`` to each row; it gives the new values and about how many bytes they have."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), fields, strict=True)], names)

        for batch in batches:
            names_in = batch.schema.names
            for values in zip(*batch.columns, strict=True):
                out, n = row(dict(zip(names_in, values, strict=True)))
                rows.append(out)
                size += n
                if size >= BATCH_BYTES:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    return df.mapInArrow(run, schema)


def transform(
    docs: DataFrame, text: str = "text", unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7, sentinels: Sequence[str] = SENTINELS
) -> DataFrame:
    """``doc_id``, units ``n``, ``form``, code points of prefix and middle, ``output`` and its hash.

    ``rate`` in 100 texts are changed, ``spm_rate`` in 100 of those have their suffix first.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    marks = [s.encode() for s in sentinels]

    def row(r: dict) -> tuple[tuple, int]:
        body = (r["text"].as_buffer() if r["text"].is_valid else None) or b""
        body, doc_id = bytes(body), r["doc_id"].as_py()
        n, form, parts = split(body, doc_id, unit, rate, spm_rate, seed, marks)
        if form == "plain":
            prefix = middle = None
            out = parts
        else:
            prefix, middle = (code_points(part) for part in parts.take(2).stream())
            out = parts.arrange(ARRANGEMENTS[form])
        return (doc_id, n, form, prefix, middle, b"".join(out.stream()), out.sha256()), len(out) + 200

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary, output_sha256 string"
    return _in_batches(columns, schema, row).withColumn("output", F.col("output").cast("string"))


def restore(arranged: DataFrame, keep: Sequence[str] = (), sentinels: Sequence[str] = SENTINELS, with_text: bool = True) -> DataFrame:
    """The columns of ``keep``, the ``restored`` text (if asked for) and its hash.

    Reads ``output`` and ``form`` only.  A null output counts as empty, a null form as plain; an
    output without the sentinels of its form is an error of the caller and fails.
    """
    marks = [s.encode() for s in sentinels]

    def row(r: dict) -> tuple[tuple, int]:
        body = bytes((r["output"].as_buffer() if r["output"].is_valid else None) or b"")
        parts = parts_of(body, r["form"].as_py() or "plain", marks).take(3)
        text = (b"".join(parts.stream()),) if with_text else ()
        return (*(r[c].as_py() for c in keep), *text, parts.sha256()), (len(parts) if with_text else 0) + 200

    kinds = dict(arranged.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), *(["restored binary"] if with_text else []), "restored_sha256 string"])
    out = _in_batches(arranged.select(*dict.fromkeys([*keep, "output", "form"])), schema, row)
    return out.withColumn("restored", F.col("restored").cast("string")) if with_text else out
