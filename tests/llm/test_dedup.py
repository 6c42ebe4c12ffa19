"""Near-duplicates, suffix trees, components: brute force on small corpora."""

import hashlib

import numpy as np
import pytest

from sortbox.llm import near_dup, substring_dedup
from sortbox.llm.components import components
from tests.llm.helpers import awkward, docs, rng, sentence, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k=4):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(r, text, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = sentence(r, 1, "xyz")
    return " ".join(w)


def near_corpus(r):
    rows = list(enumerate(awkward(r)))
    at = 100
    for n in (1, 2, 3, 5, 12, 40, 200):
        base = sentence(r, n)
        for k in range(8):
            rows.append((at, edited(r, base, k // 2 if n > 3 else 0).upper() if k == 5 else edited(r, base, k // 2 if n > 3 else 0)))
            at += 1
    # a chain: neighbours are near, ends are not
    chain = sentence(r, 120).split(" ")
    for _ in range(12):
        for _ in range(3):
            chain[r.randrange(120)] = sentence(r, 1, "uvw")
        rows.append((at, " ".join(chain)))
        at += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = near_corpus(rng(7))
    want = brute_components(rows)
    out = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)


def test_near_duplicates_when_the_hub_is_not_near(spark):
    """Copies that are near to each other and not to the bucket's least id."""
    r = rng(8)
    base = sentence(r, 60)
    rows = [(1, edited(r, base, 6))] + [(10 + i, edited(r, base, 1)) for i in range(30)] + [(500, base)]
    out = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == brute_components(rows)


def test_near_duplicates_edges(spark):
    assert near_dup.near_duplicates(docs(spark, [])).collect() == []
    out = near_dup.near_duplicates(docs(spark, [(3, "a b c d e"), (3, "a b c d e"), (None, "other words in here"), (5, None), (6, "")])).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in out) == [(0, 0, True), (3, 3, True), (3, 3, True), (5, 5, True), (6, 6, True)]


def test_densified_bins_agree_as_sets_do():
    r = rng(9)
    agree = []
    for _ in range(200):
        both = [r.getrandbits(63) for _ in range(80)]
        a, b = np.array(sorted(both[:72]), np.uint64), np.array(sorted(both[8:]), np.uint64)
        s = near_dup.signatures(np.concatenate([a, b]), np.array([0, 72, 144]))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 64 / 80) < 0.02


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9)] + [(100 + i, 101 + i) for i in range(40)]
    out = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_repeats(rows, window):
    seen = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = min(seen.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def repeat_corpus(r):
    passages = [sentence(r, n) for n in (49, 50, 51, 120)]
    rows = list(enumerate(awkward(r)))
    for i in range(60):
        parts = [sentence(r, r.randint(0, 40)), r.choice(passages), sentence(r, r.randint(0, 40)), r.choice(passages)]
        rows.append((100 + i, r.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(300 + i, "x y " * 60) for i in range(3)] + [(400 + i, "z " * (48 + i)) for i in range(5)] + [(200, rows[20][1]), (50, rows[21][1])]
    r.shuffle(rows)
    return rows


def test_repeats_against_brute_force(spark):
    rows = repeat_corpus(rng(10))
    out = substring_dedup.remove_repeats(docs(spark, rows), keep=["kept"]).collect()
    got = sorted((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept_words.encode()).hexdigest()) for x in out)
    assert got == brute_repeats(rows, 50)
    texts = dict(rows)
    for x in out:
        w = words(texts[x.doc_id])
        gone = {s.word + k for s in x.spans for k in range(s.words)}
        assert len(gone) == x.n_removed == sum(s.words for s in x.spans)
        assert x.kept_words == " ".join(v for k, v in enumerate(w) if k not in gone)


def test_repeats_keep_the_other_white_space(spark):
    r = rng(11)
    p = sentence(r, 50)
    rows = [(1, f"intro\n\n{p}\n\nend"), (2, f"one\n  two\n{p}\nlast  line\n"), (3, "as\n\nit is ")]
    out = {x.doc_id: x.kept_text for x in substring_dedup.remove_repeats(docs(spark, rows), whole_text=True).collect()}
    assert out == {1: rows[0][1], 2: "one\n  two\nlast  line\n", 3: "as\n\nit is "}


def test_repeats_edges(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).collect() == []
    p = sentence(rng(12), 50)
    out = substring_dedup.remove_repeats(docs(spark, [(None, p), (4, p), (4, p), (9, p)])).collect()
    assert sorted((x.doc_id or 0, x.n_removed) for x in out) == [(0, 0), (4, 0), (4, 0), (9, 50)]


def test_deep_nodes_across_batches():
    import pyarrow as pa

    rows = [(1, 5, 10), (1, 5, 11), (1, 5, 12), (1, 6, 3), (2, 6, 1), (2, 6, 1), (2, 6, 4)]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], ["prefix", "path", "doc_id"]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in substring_dedup.deep_nodes(iter(batches)) for r in b.to_pylist()]
        assert got == [(11, 5), (12, 5), (4, 6)]
