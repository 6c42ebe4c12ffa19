"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

A page becomes a tree of its block elements, whose leaves are runs of text (inline markup is merged
into the run, ``<br>`` is white space).  Scripts, styles, templates, frames, drawings and controls
are left out.  Each node has features of its subtree (text, links, punctuation, tags by text), its
attribute tokens and those above it (log-odds learned with the trees), its depth, and its siblings.
Trees give each node the log-probabilities of being main text, furniture, or a mix; decoding picks
the most likely labelling in which everything below a main node is main and everything below
furniture is furniture, so no ancestor contradicts a descendant.

The trees are fitted on layouts drawn at random (``html_layouts``), as no table labels pages.

A run of text is a block: white space inside becomes one space, ends are trimmed, blocks are joined
in page order by two newlines.  Null or empty html and pages without text give an empty text.
Malformed html is read as far as it goes: elements left open end with their parent, a tag or comment
left open runs to the end of the page.  Time grows with a page's length, whatever its markup; elements
nested deeper than ``MAX_DEPTH`` are blocks of the one at that depth.  The attribute ``hidden`` is a
feature and leaves nothing out by itself.  Repeated rows are extracted alike, an empty table gives an empty result, and columns other than the named ones are
neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortbox.llm import boosting, html_layouts, html_tokens

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
DROPPED = {"script", "style", "noscript", "template", "head", "title", "iframe", "svg", "canvas", "object", "button", "select", "textarea", "audio", "video", "math", "datalist"}
HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "center", "nobr",
}
# An opening tag of the key ends an open element of the values, up to the nearest of its bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
KINDS = ["#text", "p", "h1", "h2", "h3", "li", "ul", "ol", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "table", "tr", "td", "blockquote", "pre", "figure", "dl", "body"]
KIND = {k: i + 1 for i, k in enumerate(KINDS)}
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MAIN, FURNITURE, MIXED = 0, 1, 2
MAX_DEPTH = 512  # as in browsers
TRAIN_PAGES = 1800
TRAIN_SEED = 2024
_SPACE = re.compile(r"\s+")


@dataclass
class Nodes:
    """Nodes of some pages in page order; a subtree is a range of nodes."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    part: list[str] = field(default_factory=list)  # label, in training pages only
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links
    links: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)


@lru_cache(100_000)
def attribute_tokens(value: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t.lower() for t in TOKEN.findall(value) if len(t) > 1))


class Reader:
    """Builds the nodes of pages; ``read`` takes one page after the other."""

    def __init__(self, nodes: Nodes):
        self.nodes = nodes

    def read(self, page: int, html: str) -> None:
        self.page, self.open, self.names = page, [], []
        self.at: dict[str, list[int]] = defaultdict(list)  # places of the open elements of a name
        self.dropped, self.in_dropped, self.in_link = [], Counter(), 0
        self.run: list[str] = []
        self.run_linked = self.run_links = self.run_controls = 0
        self.enter("body", [])
        for kind, value, attrs, closed in html_tokens.tokens(html):
            if kind == html_tokens.TEXT:
                self.text(value)
            elif kind == html_tokens.END:
                self.end_tag(value)
            elif not closed or value in VOID:
                self.start_tag(value, attrs)
            elif value not in DROPPED:
                self.start_tag(value, attrs)
                self.end_tag(value)
        while self.open:
            self.leave()

    def last(self, names: Collection[str]) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((self.at[x][-1] for x in names if self.at[x]), default=0)

    def drop(self, tag: str) -> None:
        self.dropped.append(tag)
        self.in_dropped[tag] += 1

    def undrop(self) -> None:
        self.dropped, self.in_dropped = [], Counter()

    def enter(self, tag: str, attrs: list) -> None:
        n = self.nodes
        self.at[tag].append(len(self.names))
        self.names.append(tag)
        if len(self.open) >= MAX_DEPTH:
            self.open.append(self.open[-1])
            return
        values, hidden, part = [tag] if tag not in KIND else [], False, ""
        for k, v in attrs:
            if k in ("class", "id", "role", "itemprop"):
                values.append(v or "")
            elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "")):
                hidden = True
            elif k == "data-part":
                part = v or ""
        self.add(KIND.get("h3" if tag in ("h4", "h5", "h6") else "td" if tag == "th" else tag, 0), tuple(t for v in values for t in attribute_tokens(v)), hidden, part)
        self.open.append(len(n.page) - 1)

    def add(self, kind: int, tokens: tuple[str, ...], hidden: bool, part: str, text: str = "") -> None:
        n = self.nodes
        up = self.open[-1] if self.open else -1
        n.page.append(self.page)
        n.parent.append(up)
        n.end.append(len(n.page))
        n.depth.append(n.depth[up] + 1 if up >= 0 else 0)
        n.kind.append(kind)
        n.tokens.append(tokens)
        n.hidden.append(hidden)
        n.part.append(part)
        n.text.append(text)
        n.linked.append(self.run_linked if text else 0)
        n.links.append(self.run_links if text else 0)
        n.controls.append(0)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.run)).strip()
        if text:
            self.add(KIND["#text"], (), False, "", text)
        if self.open:
            self.nodes.controls[self.open[-1]] += self.run_controls
        self.run = []
        self.run_linked = self.run_links = self.run_controls = 0

    def leave(self) -> None:
        self.flush()
        self.nodes.end[self.open.pop()] = len(self.nodes.page)
        self.at[self.names.pop()].pop()
        self.in_link = 0

    def start_tag(self, tag: str, attrs: html_tokens.Attributes) -> None:
        if self.dropped == ["head"] and tag not in HEAD or tag == "body" and self.in_dropped["head"]:
            self.undrop()
        if tag in DROPPED:
            if tag in ("button", "select", "textarea"):
                self.run_controls += 1
            self.drop(tag)
            return
        if self.dropped:
            if tag not in VOID:
                self.drop(tag)
            return
        if tag == "br":
            self.run.append(" ")
        elif tag in VOID:
            self.run_controls += tag == "input"
            if tag == "hr":
                self.flush()
        elif tag == "a":
            self.in_link, self.run_links = 1, self.run_links + 1
        elif tag in INLINE and not (tag == "ins" and attrs):
            pass
        elif tag == "html":
            pass
        elif tag == "body" and self.names:
            for k, v in attrs:
                if k in ("class", "id"):
                    self.nodes.tokens[self.open[0]] += attribute_tokens(v or "")
        else:
            if "p" in self.names[-1:]:
                self.leave()
            close, bound = CLOSES.get(tag, ((), ()))
            while (place := self.last(close)) > self.last(bound):
                while len(self.names) > place:
                    self.leave()
            self.flush()
            self.enter(tag, attrs)

    def end_tag(self, tag: str) -> None:
        if self.dropped:
            if self.in_dropped[tag]:
                while True:
                    gone = self.dropped.pop()
                    self.in_dropped[gone] -= 1
                    if gone == tag:
                        return
            if not self.last([tag]):
                return
            self.undrop()  # the end of an element around it
        if tag == "a":
            self.in_link = 0
        elif len(tag) == 2 and tag[0] == "h" and self.names[-1:] and re.fullmatch("h[1-6]", self.names[-1]) and tag[1] in "123456":
            self.leave()
        elif place := self.last([tag]):
            while len(self.names) > place:
                self.leave()

    def text(self, data: str) -> None:
        if self.dropped == ["head"] and not data.isspace():
            self.undrop()
        if not self.dropped:
            self.run.append(data)
            if self.in_link:
                self.run_linked += len(data)


def read_pages(pages: list[str | None]) -> Nodes:
    nodes = Nodes()
    reader = Reader(nodes)
    for i, html in enumerate(pages):
        if html and not html.isspace():
            reader.read(i, html)
    return nodes


def _subtree(own: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.zeros(len(own) + 1)
    np.cumsum(own, out=c[1:])
    return c[end] - c[:-1]


def features(n: Nodes, odds: dict[str, float]) -> np.ndarray:
    count = len(n.page)
    parent, end, kind = np.array(n.parent, np.int64), np.array(n.end, np.int64), np.array(n.kind, np.int64)
    page, depth = np.array(n.page, np.int64), np.array(n.depth, np.float64)
    chars = np.fromiter(map(len, n.text), np.float64, count)
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in n.text), np.float64, count)
    stops = np.fromiter((t.count(",") + t.count(".") + t.count(";") for t in n.text), np.float64, count)
    marks = np.fromiter((t.count("|") + t.count("©") + t.count("·") + t.count("»") for t in n.text), np.float64, count)
    long_run = (chars > 120).astype(np.float64)
    linked, links, controls = np.array(n.linked, np.float64), np.array(n.links, np.float64), np.array(n.controls, np.float64)
    own = np.array([[sum(v := [odds.get(t, 0.0) for t in ts]), min(v), max(v)] if ts else [0.0, 0.0, 0.0] for ts in n.tokens]).reshape(count, 3)
    sums = [_subtree(v, end) for v in (chars, words, stops, marks, linked, links, controls, long_run, (kind != KIND["#text"]).astype(float), (kind == KIND["#text"]).astype(float), (kind == KIND["p"]).astype(float), (kind == KIND["li"]).astype(float))]
    s_chars, s_words, s_stops, s_marks, s_linked, s_links, s_controls, s_long, s_tags, s_runs, s_p, s_li = sums
    # What lies above: attribute odds and furniture or article tags, passed down level by level.
    up_min, up_max, up_sum = np.zeros(count), np.zeros(count), np.zeros(count)
    above = np.zeros((count, 4))
    signs = [np.isin(kind, [KIND[k] for k in ks]).astype(float) for ks in (("nav", "header", "footer"), ("aside", "form"), ("article", "main"), ("p", "blockquote", "li", "td"))]
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if count else []
    for at in levels[1:]:
        p = parent[at]
        up_min[at], up_max[at], up_sum[at] = np.minimum(up_min[p], own[p, 1]), np.maximum(up_max[p], own[p, 2]), up_sum[p] + own[p, 0]
        for j, sign in enumerate(signs):
            above[at, j] = above[p, j] + sign[p]
    root = parent < 0
    top = np.maximum.accumulate(np.where(root, np.arange(count), 0)) if count else np.empty(0, np.int64)
    whole = np.maximum(s_chars[top], 1)
    before = np.cumsum(chars) - chars
    p = np.where(root, np.arange(count), parent)
    # Siblings: parent's numbers without the node's own.
    n_sib = np.bincount(p, minlength=count)[p].astype(np.float64)
    sib_chars = (s_chars[p] - s_chars) / np.maximum(n_sib - 1, 1)
    same = p * (len(KINDS) + 1) + kind
    _, back, reps = np.unique(same, return_inverse=True, return_counts=True)
    order = np.lexsort((np.arange(count), p))
    prev_chars, next_chars, nth = np.zeros(count), np.zeros(count), np.zeros(count)
    if count > 1:
        together = p[order[1:]] == p[order[:-1]]
        prev_chars[order[1:][together]] = s_chars[order[:-1][together]]
        next_chars[order[:-1][together]] = s_chars[order[1:][together]]
        nth[order] = np.arange(count) - np.searchsorted(p[order], p[order])
    density = s_chars / (s_tags + 1)
    columns = [
        kind, kind[p], depth, np.log1p(s_chars), np.log1p(s_words), s_linked / np.maximum(s_chars, 1), s_links / np.maximum(s_words, 1), s_stops / np.maximum(s_words, 1),
        s_marks / np.maximum(s_words, 1), s_chars / np.maximum(s_words, 1), np.log1p(density), np.log1p(density[p]), np.log1p(density[top]), np.log1p(s_tags), s_runs, s_p / (s_tags + 1),
        s_li / (s_tags + 1), s_controls, s_long, s_long / np.maximum(s_runs, 1), s_chars / whole, s_chars[p] / whole, (before - before[top]) / whole, (before - before[top] + s_chars) / whole,
        s_linked[p] / np.maximum(s_chars[p], 1), s_p[p], s_long[p], n_sib, reps[back], np.log1p(sib_chars), np.log1p(prev_chars), np.log1p(next_chars), nth, (n_sib - nth),
        own[:, 0], own[:, 1], own[:, 2], own[p, 0], up_min, up_max, up_sum, *above.T, np.array(n.hidden, float), _subtree(np.minimum(own[:, 1], 0), end), np.log1p(whole),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1).astype(np.float32)


def labels(n: Nodes) -> np.ndarray:
    """Label of every node of training pages; -1 without text."""
    part = [""] * len(n.page)
    for i, p in enumerate(n.parent):
        part[i] = n.part[i] or (part[p] if p >= 0 else "b")
    end = np.array(n.end)
    text = np.fromiter((bool(t) for t in n.text), bool, len(n.text))
    main = _subtree(np.array([float(bool(t) and q == "m") for t, q in zip(n.text, part, strict=True)]), end)
    runs = _subtree(text.astype(float), end)
    return np.where(runs == 0, -1, np.where(main == runs, MAIN, np.where(main == 0, FURNITURE, MIXED)))


@dataclass
class Model:
    odds: dict[str, float]
    trees: boosting.Trees


def fit(pages: list[str], rounds: int = 36) -> Model:
    """Token log-odds from half of the pages, trees from the other half."""
    half = len(pages) // 2
    n, y = (nodes := read_pages(pages[:half])), labels(nodes)
    seen: dict[str, list[int]] = {}
    for ts, label in zip(n.tokens, y, strict=True):
        for t in ts if label in (MAIN, FURNITURE) else ():
            seen.setdefault(t, [0, 0])[label] += 1
    odds = {t: float(np.log((a + 0.5) / (b + 0.5))) for t, (a, b) in seen.items() if a + b >= 3}
    n = read_pages(pages[half:])
    y = labels(n)
    return Model(odds, boosting.fit(features(n, odds)[y >= 0], y[y >= 0], 3, rounds))


@lru_cache(2)
def default_model(n: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> Model:
    return fit(html_layouts.pages(n, seed))


def decode(n: Nodes, logp: np.ndarray) -> list[bool]:
    """Whether each node is main text, in the most likely labelling without contradictions."""
    count, parent = len(n.page), n.parent
    main, furniture, mixed = ([*v] for v in logp.T.astype(float).tolist())
    # Sums over subtrees when all of it is main, all is furniture, or the node is mixed.
    for i in range(count - 1, -1, -1):
        p = parent[i]
        if p >= 0:
            main[p] += main[i]
            furniture[p] += furniture[i]
            mixed[p] += max(main[i], furniture[i], mixed[i] if n.end[i] > i + 1 else -1e18)
    state = [FURNITURE] * count
    for i in range(count):
        p = parent[i]
        if p >= 0 and state[p] != MIXED:
            state[i] = state[p]
        else:
            best = (main[i], furniture[i], mixed[i] if n.end[i] > i + 1 else -1e18)
            state[i] = best.index(max(best))
    return [s == MAIN for s in state]


def extract(model: Model, pages: list[str | None]) -> list[str]:
    out: list[list[str]] = [[] for _ in pages]
    n = read_pages(pages)
    if n.page:
        keep = decode(n, model.trees.log_probabilities(features(n, model.odds)))
        for i, text in enumerate(n.text):
            if text and keep[i]:
                out[n.page[i]].append(text)
    return ["\n\n".join(b) for b in out]


def extract_text(pages: DataFrame, keep: list[str], html: str = "html", model: Model | None = None, batch_chars: int = 2_000_000) -> DataFrame:
    """``keep`` columns, the main ``text`` of each page and its code points ``n_chars``."""
    model = model or default_model()
    rows = pages.select(*keep, F.col(html).alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string, n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, texts, lo, size = batch.column(batch.num_columns - 1).to_pylist(), [], 0, 0
            for i, h in enumerate(html):
                size += len(h or "")
                if size >= batch_chars or i == len(html) - 1:
                    texts += extract(model, html[lo : i + 1])
                    lo, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(run, schema)
