"""Token counts by byte-pair merging with a heap and a linked list.

A word's symbols are a doubly linked list; a heap holds the ranks of adjacent pairs that the
vocabulary merges.  The lowest rank (the leftmost of equal ones) is popped, its pair joined, and the
pairs with the new neighbours are pushed; entries whose pair has changed since are skipped.  A word
has as many tokens as symbols at the start minus merges, so no identifiers are made.

The rules before the merges are those of the vocabulary file: added tokens are found first and count
one each, the rest is normalised and split into words.  White space ends words and is dropped, so a
text's count is the sum over its white-space separated parts.  Parts and words are counted once and
kept in bounded tables of each task.  Parts beyond the Latin letters are normalised and split by the
file's own rules, run by the library, because the classes of rare characters depend on its Unicode
version.

Null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results, an empty table an
empty one.  Texts are read in slices of about ``SLICE`` characters that end at white space; a part
without white space is read whole, with about 200 bytes of memory for each byte of its longest word.
Columns of the input other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
SLICE = 1 << 20
REMEMBERED = 400_000  # words, and parts, of a generation kept in a task, of up to LONGEST characters each
LONGEST = 48
SHIFT = 24  # a pair of symbols is one number: the first shifted by so many bits, and the second
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
SPACE = re.compile(r"[\x20\x09-\x0D]")
# ``str.split`` takes these for white space, the file does not.
SEPARATORS = re.compile(r"[\x1c-\x1f]")
PART = re.compile(r"[^\x20\x09-\x0D]+")
# Parts whose characters have the same classes in every Unicode version and no composed forms, and
# what the file's split keeps of them in lower case.
LATIN = re.compile(r"[\x21-\x7e\xa1-\u024f]+")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def tokens_left(symbols: list[int], rank: Callable[[int], int | None], made: list[int]) -> int:
    """How many symbols are left when no pair can be merged any more (changes ``symbols``).

    ``rank`` gives the rank of a pair (one number, see ``SHIFT``), ``made`` the symbol that a rank makes.
    """
    n = len(symbols)
    heap = [(r, i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(a << SHIFT | b)) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pop, push, merges = heapq.heappop, heapq.heappush, 0
    while heap:
        r, i = pop(heap)
        j, left = after[i], symbols[i]
        if left < 0 or j == n or rank(left << SHIFT | symbols[j]) != r:
            continue  # the pair is gone
        symbols[i] = left = made[r]
        symbols[j] = -1
        merges += 1
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            if (r := rank(left << SHIFT | symbols[j])) is not None:
                push(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := rank(symbols[h] << SHIFT | left)) is not None:
            push(heap, (r, h))
    return n - merges


class Remembered(dict):
    """Results of a function of a short string: two generations, the older one goes when one is full."""

    def __init__(self, of: Callable[[str], int], limit: int = REMEMBERED):
        super().__init__()
        self.of, self.limit = of, limit
        self.older: dict[str, int] = {}

    def __missing__(self, key: str) -> int:
        value = self.older.get(key)
        if value is None:
            value = self.of(key)
        if len(key) <= LONGEST:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Counter:
    """Counts tokens as the library gives them for a word-end BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        symbol = model["vocab"]  # of a string; symbols never leave the task
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {symbol[left] << SHIFT | symbol[right]: i for i, (left, right) in enumerate(merges)}
        self.rank, self.made = ranks.get, [symbol[left + right] for left, right in merges]
        self.first, self.last = symbol.get, {c: symbol.get(c + (model["end_of_word_suffix"] or "")) for c in symbol if len(c) == 1}.get
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        # Printable bytes stand for themselves, the others from U+0100 up.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        rules = Tokenizer.from_file(path)
        self.normalize, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.words, self.parts = Remembered(self.word), Remembered(self.part)

    def word(self, shown: str) -> int:
        """Tokens of a word, whose bytes are written as the file writes them."""
        symbols = [*map(self.first, shown[:-1]), self.last(shown[-1])]
        if None in symbols:  # the file drops bytes that its vocabulary lacks
            symbols = [s for s in symbols if s is not None]
        return tokens_left(symbols, self.rank, self.made)

    def piece(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if LATIN.fullmatch(text):
            words = [w if w.isascii() else w.encode().decode("latin-1").translate(self.shown) for w in WORD.findall(text.lower())]
        else:
            words = [w for w, _ in self.split(self.normalize(text))]
        return sum(map(self.words.__getitem__, words))

    def part(self, text: str) -> int:
        if self.added is None:
            return self.piece(text)
        pieces = self.added.split(text)  # every second piece is an added token
        return sum(self.piece(p) for p in pieces[::2] if p) + len(pieces) // 2

    def text(self, text: str) -> int:
        of = self.parts.__getitem__
        return sum(sum(map(of, PART.findall(s) if SEPARATORS.search(s) else s.split())) for s in slices(text))


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices that end before white space."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


@lru_cache(2)
def counter(path: str | None = None) -> Counter:
    import public_tokenizers

    return Counter(path or public_tokenizers.path("word_bpe_49k.json"))


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, bytes and tokens of each text, and whether it has more than ``limit`` tokens.

    ``path`` names a byte-level BPE file with word ends; the default is ``word_bpe_49k.json``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                body = value.as_py() or ""
                n_bytes.append(len(body) if body.isascii() else len(body.encode()))
                n_tokens.append(of.text(body))
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, SCHEMA)
