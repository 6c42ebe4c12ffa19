"""Vectorised word kernel: word bounds and 64-bit hashes straight from Arrow buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Those bytes never occur inside a
multi-byte UTF-8 character, so the bounds found on bytes are those of the characters.  Work is
done on chunks of whole rows of about ``CHUNK`` bytes (one row when a text is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (mod 2**64), at least ``n`` of them."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values; empty when there are fewer than ``k``."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _power(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=c[1:])
    return mix((c[k:] - c[:-k]) * down[: n - k + 1] + np.uint64(k))


class Chunk:
    """Rows ``lo``..``hi`` of a batch: bytes, row offsets, word bounds and the row of each word."""

    def __init__(self, lo: int, hi: int, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.lo, self.hi, self.offs = lo, hi, offs
        self.buf = buf = _LOWER[buf] if lower else buf
        n = len(buf)
        if n:
            space = _SPACE[buf]
            edge = np.zeros(n + 1, bool)
            edge[offs] = True
            before = edge[:n].copy()
            before[1:] |= space[:-1]
            after = edge[1:].copy()
            after[:-1] |= space[1:]
            np.logical_not(space, out=space)
            self.starts = np.flatnonzero(space & before)
            self.ends = np.flatnonzero(space & after) + 1
        else:
            self.starts = self.ends = np.empty(0, np.int64)
        # Word numbers at which each row begins: row i has words bounds[i]..bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return self.hi - self.lo

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        up, down = _power(n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * up[:n], out=c[1:])
        return mix((c[self.ends] - c[self.starts]) * down[self.starts])

    def rows(self) -> np.ndarray:
        """The row (from 0) of every word."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def char_counts(self) -> np.ndarray:
        """Code points of every word."""
        lead = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=lead[1:])
        return lead[self.ends] - lead[self.starts]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of whole rows of about ``size`` bytes that cover the column."""
    buf, offs = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield Chunk(lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lower)
        lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary(values: list[np.ndarray]) -> pa.Array:
    """A binary column with the bytes of each array."""
    sizes = np.fromiter((v.nbytes for v in values), np.int64, len(values))
    offs = np.zeros(len(values) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    data = np.concatenate([v.view(np.uint8) for v in values]) if len(values) else np.empty(0, np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(offs), pa.py_buffer(data)]).cast(pa.binary())
