"""Piece tables, token counts and the divergence audit: libraries, brute force, small cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortbox.llm import divergence, infill, queries, token_counts
from tests.llm.helpers import awkward, docs, rng, sentence

# --- fill-in-the-middle ---------------------------------------------------------------------------


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 100:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), out


def infill_texts():
    r = rng(11)
    lines = ["\n".join(sentence(r, r.randint(0, 6)) for _ in range(r.randint(1, 30))) for _ in range(60)]
    return [*awkward(r), *lines, "a\n", "\n", "\n\n\n", "x <P> y", "<S>", "<M", "<P<P", "é\n漢字\n😀", "a\r\nb c\x0bd\n", "y\n" * 200_000]


def test_infill_against_brute_force(spark, tmp_path):
    rows = list(enumerate(infill_texts()))
    rows += [rows[20], (None, "no id\nat all")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted((str(i), *brute_infill(i, t)[:4], sha(brute_infill(i, t)[4]), sha(t)) for i, t in rows)
    got = queries.QUERIES["op11_piece_table_infill"](spark, str(tmp_path)).collect()
    assert got[0].__fields__ == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_infill_gives_texts_and_takes_them_back(spark):
    rows = list(enumerate(infill_texts()[:-1]))
    table = docs(spark, rows)
    for unit, rate, spm, seed in (("line", 100, 50, 7), ("character", 60, 0, 3), ("character", 100, 100, 1)):
        out = infill.transform(table, unit=unit, rate=rate, spm_rate=spm, seed=seed)
        got = {r.doc_id: r for r in infill.restore(out, keep=["doc_id", "form", "output"]).collect()}
        for i, text in rows:
            assert got[i].restored == (text or "") and got[i].restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        forms = Counter(r.form for r in got.values())
        assert (rate == 100 or forms["plain"] > 15) and (spm > 0 or not forms["spm"]) and (spm < 100 or not forms["psm"])
    with pytest.raises(ValueError):
        infill.transform(table, unit="page")


def test_infill_sees_only_output_and_form(spark):
    out = spark.createDataFrame([("<S>c<P>a\n<M>b", "spm"), ("<P><S><M>", "psm"), ("x", "plain"), (None, None)], "output string, form string")
    assert [r.restored for r in infill.restore(out).collect()] == ["a\nbc", "", "x", ""]


def test_infill_empty(spark):
    assert infill.transform(docs(spark, [])).collect() == []
    assert infill.restore(infill.transform(docs(spark, []))).collect() == []


def test_piece_table_moves_descriptors_only():
    text = b"one two three"
    table = infill.PieceTable((text, b"|"), [(0, 0, len(text))])
    cut = table.cut(0, [4, 8])
    assert cut.pieces == ((0, 0, 4), (0, 4, 8), (0, 8, 13)) and len(cut) == len(text)
    order = (2, 0, 1)
    moved = cut.arrange(order)
    assert b"".join(moved.stream()) == b"threeone two "
    assert moved.arrange(infill.inverse(order)).pieces == cut.pieces
    assert moved.sha256() == hashlib.sha256(b"threeone two ").hexdigest()
    assert table.pieces == ((0, 0, 13),) and moved.buffers[0].obj is text


# --- token counts ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_against_the_library(spark, library):
    r = rng(12)
    odd = "abcdeABΣςİȩ́ \t\n\x1c\x85\xa0　'std12<|>endoftext漢😀‍\x00.ﬁ½²"
    texts = [*awkward(r), *("".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(800))]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|><|endoftext|>", "it'll we'Re 'S", "<|endoftext", " " * 100_000, "a" * 20_000, "漢" * 5000, "ab " * 600_000]
    rows = [*enumerate(texts), (3, "x"), (None, "no id")]
    got = sorted((str(x.doc_id), x.n_bytes, x.n_tokens, x.over_limit) for x in token_counts.count_tokens(docs(spark, rows)).collect())
    assert got == sorted((str(i), len((t or "").encode()), n := library(t), n > 2048) for i, t in rows)
    assert {x[3] for x in got} == {True, False}


def test_token_counts_of_every_character(library):
    count = token_counts.counter().text
    points = [*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x10400), *range(0x1F000, 0x1FB00), *range(0xE0000, 0xE0100)]
    assert [c for c in points if count(t := f"a{chr(c)}a1{chr(c)}1 x{chr(c)}") != library(t)] == []


def test_token_counts_of_documents(spark, library):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library(r.text) for r in table.select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table).collect()} == want


def test_merging_pops_the_lowest_rank_and_the_leftmost():
    made = [10, 11, 12]  # ab, bc, (ab)c
    ranks = {1 << 24 | 2: 0, 2 << 24 | 3: 1, 10 << 24 | 3: 2}
    left = lambda *s: token_counts.tokens_left(list(s), ranks.get, made)
    assert left() == 0 and left(1) == 1 and left(1, 2, 3) == 1 and left(2, 3, 1, 2) == 2 and left(3, 3) == 2
    same = {1 << 24 | 1: 0}
    assert token_counts.tokens_left([1] * 5, same.get, [9]) == 3


def test_remembered_results_are_bounded():
    calls = []
    table = token_counts.Remembered(lambda s: calls.append(s) or len(s), limit=3)
    for word in "a b c d a e f g h a".split() * 3 + ["x" * 100] * 2:
        assert table[word] == len(word)
        assert len(table) <= 3 and len(table.older) <= 3
    assert calls.count("x" * 100) == 2


def test_slices_end_at_white_space():
    text = "aaa bb\tcccccc d  e" * 3
    assert "".join(token_counts.slices(text, 2)) == text
    assert [p for s in token_counts.slices(text, 2) for p in s.split()] == text.split()
    assert list(token_counts.slices("", 2)) == []


def test_token_counts_empty(spark):
    assert token_counts.count_tokens(docs(spark, [])).collect() == []


# --- divergence -----------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_audit(rows, min_docs=3, top=200):
    lower = {c: c + 32 for c in range(65, 91)}
    by_group, in_docs = {}, {}
    for _, text, lang, source in rows:
        lang, terms = lang or "", TERM.findall((text or "").translate(lower))
        by_group.setdefault((lang, source or ""), Counter()).update(terms)
        in_docs.setdefault(lang, Counter()).update(set(terms))
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in in_docs.items()}

    def share(counts, lang):
        total = sum(counts[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept[lang]}

    whole = {lang: sum((c for (x, _), c in by_group.items() if x == lang), Counter()) for lang in kept}
    p = {g: share(c, g[0]) for g, c in by_group.items()}
    q = {lang: share(c, lang) for lang, c in whole.items()}
    out = []
    for (lang, source), counts in by_group.items():
        f = lambda a, b: (a - b) ** 2 // b
        mine = p[lang, source]
        pair = [(sum(f(mine[t], p[lang, o][t]) for t in kept[lang]), o) for x, o in by_group if x == lang and o != source]
        term = [(f(mine[t], q[lang][t]), t) for t in kept[lang] if counts[t] and mine[t] > q[lang][t]]
        for part, items in (("pair", pair), ("term", term)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def audit_rows():
    r = rng(13)
    pools = {lang: [sentence(r, 1, alphabet) for _ in range(120)] for lang, alphabet in (("en", "abcdef"), ("fr", "éàgh漢"), (None, "xyz"))}
    rows, i = [], 0
    for lang, pool in pools.items():
        for k in range(150):
            source = "hot" if k % 3 == 0 else f"s{k % 20}"
            weights = [1 + (hash_of(source, w) % 9) for w in pool]
            words = r.choices(pool, weights, k=r.randint(0, 40))
            rows.append((i, " ".join(w.upper() if r.random() < 0.2 else w for w in words), lang, source))
            i += 1
    rows += [(9000, None, "en", "silent"), (9001, "", "en", None), (9002, "12 34 !!", "none", "a"), (9003, "once", "none", "b"), (9004, "lone word", "one", "x")]
    rows += [(9005, "same same-same same3same", "en", "s1")] * 3 + [(9006, "abc " * 3000, "en", "s2"), (None, "abc", "en", "")]
    return rows


def hash_of(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:6], 16)


def test_audit_against_brute_force(spark):
    rows = audit_rows()
    for settings in ({}, {"block": 2, "stretch": 2, "held": 50, "top": 5, "min_docs": 1}):
        got = divergence.audit(docs(spark, rows), **settings).collect()
        want = brute_audit(rows, settings.get("min_docs", 3), settings.get("top", 200))
        assert sorted(tuple(r) for r in got) == want
    assert {"", "en", "fr", "none"} <= {r.lang for r in got}


def test_audit_empty_and_without_terms(spark):
    assert divergence.audit(docs(spark, [])).collect() == []
    rows = [(1, "1 2 3", "en", "a"), (2, None, "en", "b"), (3, "word", "en", "c")]
    got = sorted(tuple(r) for r in divergence.audit(docs(spark, rows)).collect())
    assert got == brute_audit(rows) and len(got) == 6 and all(r[4] == 0 for r in got)


def test_shares_are_exact_at_any_size():
    for total in (1, 3, 7, 10**9 + 7, 9 * 10**15):
        counts = np.array([c for c in (0, 1, 2, 5, 10**6, 10**12, 9 * 10**14) if c < total], np.int64)
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_galloping_intersection():
    r = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (1, 1), (10, 100_000), (5000, 6000), (3000, 3000), (40, 41)):
        a, b = (np.unique(r.integers(0, 20_000 if n < 5000 else 8000, k)) for k in (n, m))
        i, j = divergence.intersect(a, b)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Été one TWO three3four " * 50).encode()
    (whole,) = divergence.text_terms(text)
    monkeypatch.setattr(divergence, "SLICE", 7)
    cut = [t for terms in divergence.text_terms(text) for t in terms]
    assert cut == whole and Counter(whole)[b"two"] == 50 and Counter(whole)["Été".encode()] == 50


def test_term_counts_pass_on_in_parts(spark):
    rows = audit_rows()
    table = docs(spark, rows)
    few = divergence.term_counts(table, held=10).orderBy("lang", "source", F.col("term").asc_nulls_first()).collect()
    assert few == divergence.term_counts(table).orderBy("lang", "source", F.col("term").asc_nulls_first()).collect()


# --- hard texts for earlier operators -------------------------------------------------------------


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_200_000, "a" + "\t \n" * 500_000 + "b <|endoftext|> c", "　" * 1_000_000])
def test_packing_of_long_white_space(spark, text):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from sortbox.llm import packing

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for added in (True, False):
        t.encode_special_tokens = not added
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        pieces = packing.pack_documents(docs(spark, [(1, text), (2, "x")]), added=added).where("doc_id = 1").orderBy("start").collect()
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)


BROKEN = {
    "tags": "<a " * 350_000, "comments": "<!--" * 250_000, "ends": "</" * 500_000, "blocks": "<div>" * 200_000, "names": "<" * 1_000_000, "quotes": "<p a='" * 170_000,
    "strange ends": "<div>" * 100_000 + "</x>" * 100_000, "cells": "<td>" + "<div>" * 90_000 + "<table>" + "<div>" * 90_000 + "<tr></tr>" * 10_000, "buttons": "<button>" * 60_000 + "</x>" * 100_000,
    "titles": "<title>" * 140_000, "references": "&#" + "9" * 1_000_000, "zeros": "&#" + "0" * 1_000_000 + "65;", "lists": "<li><ul>" * 120_000, "attributes": "<p " + "a=b " * 250_000 + ">x", "cdata": "<![CDATA[" * 110_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_linear_time(name):
    import time

    from sortbox.llm import html_extraction

    model = html_extraction.default_model()
    began = time.process_time()
    html_extraction.extract(model, ["<p>" + "A sentence of the article, long enough to stay. " * 20 + "</p>" + BROKEN[name]])
    assert time.process_time() - began < 5


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("a &lt; b < c &amp;&#65;&#x42;&#0000000000067; &#99999999; &nosuch; d", ["a < b < c &ABC � &nosuch; d"]),
        ("x<!-- <p>no</p> -->y<!-->z<!--->w<!doctype html><?php no ?></>q</ no>r", ["xyzwqr"]),
        ("<P CLASS='a>b' id=c>one<Br/>two</P ><p data-x>three", ["one two", "three"]),
        ("<script>if (a < b) '</p>'</script >kept<style>p{}</style>", ["kept"]),
        ("<title>a <b> c</title>kept<textarea><p>no</textarea> too", ["kept too"]),
        ("kept<p title='never closed", ["kept"]),
        ("kept<!-- never closed", ["kept"]),
        ("<div>" * 600 + "deep<p>er</p>" + "</div>" * 600 + "<p>after", ["deep", "er", "after"]),
    ],
)
def test_tokens_of_html(page, want):
    from sortbox.llm import html_extraction

    nodes = html_extraction.read_pages([page])
    assert [t for t in nodes.text if t] == want
    for i, p in enumerate(nodes.parent):
        assert p < i and (p < 0 or nodes.end[i] <= nodes.end[p])


def test_language_vectors_of_a_large_alphabet_in_bounded_memory():
    import tracemalloc

    from sortbox.llm import language_id

    r = rng(21)
    texts = ["".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(500)) for _ in range(1000)]
    alphabet, tri, row = language_id.trigrams(texts)
    tracemalloc.start()
    v = language_id.bundles(alphabet, tri, row, len(texts), language_id.DIM, language_id.SEED)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    for i in (0, 517, 999):
        a, t, g = language_id.trigrams([texts[i]])
        counts, bound = language_id.counted(a, t, g, 1, language_id.DIM, language_id.SEED)
        assert (counts @ bound.astype(np.int64) == v[i]).all()


def test_lesser_licence_headers_are_not_taken_for_the_general_one(spark):
    from sortbox.llm import licenses

    head = "/* This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version. */"
    want = {"a": ("library", "Lesser General Public", "2.1", "LGPL-2.1"), "b": ("program", "General Public", "2", "GPL-2.0"), "c": ("program", "General Public", "3", "GPL-3.0")}
    rows = [(f"{k}.c", head.format(what=w, name=n, v=v)) for k, (w, n, v, _) in want.items()] + [(f"x{i}.c", f"plain text number {i}") for i in range(30)]
    out = licenses.own_licenses(spark.createDataFrame(rows, "path string, text string")).collect()
    assert {r.path[0]: r.license for r in out} == {k: x[3] for k, x in want.items()}
