"""Toxicity, extraction, decontamination, licences: gradients, accuracy, planted cases."""

import html
from collections import Counter

import numpy as np
import pytest

from sortbox.llm import boosting, decontamination, html_extraction, html_layouts, licenses, toxicity
from tests.llm.helpers import awkward, docs, rng, sentence


# --- toxicity -------------------------------------------------------------------------------


def test_gradients_against_finite_differences():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity._start(r).items() if k not in ("word", "gram")}
    x = r.standard_normal((6, 2 * toxicity.WIDTH + 2))
    x[-1] = 0
    ids = r.integers(0, 6, (5, 3))
    ids[3:, 0] = 5  # beyond the text
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        logit = toxicity._pool(p, toxicity._run(p, x, ids, 5, False)[0].astype(np.float64), ids != 5)[0]
        return float((weight * np.logaddexp(0, np.where(y > 0, -logit, logit))).sum() / weight.sum())

    g, dx, _ = toxicity.gradients(p, x, ids, 5, y, weight)
    for k in [*g, "x"]:
        values, grad = (x, dx) if k == "x" else (p[k], g[k])
        for at in [tuple(r.integers(0, n) for n in values.shape) for _ in range(4)]:
            if k == "x" and at[0] == 5:
                continue
            old = values[at]
            values[at] = old + 1e-3
            up = loss()
            values[at] = old - 1e-3
            down = loss()
            values[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3, (k, at)


def test_windows_cover_every_word():
    texts = ["", "one", "w " * 32, "w " * 33, "w " * 500, None]
    w = toxicity.read_words(texts)
    begin, row = toxicity.windows(w, len(texts))
    covered = set()
    for b, i in zip(begin, row, strict=True):
        covered |= {k for k in range(b, b + toxicity.LENGTH) if k < len(w.row) and w.row[k] == i}
    assert covered == set(range(len(w.row)))


def test_a_passage_at_any_place_lies_whole_in_a_window():
    begin, _ = toxicity.windows(toxicity.read_words(["w " * 400]), 1)
    for at in range(400 - 17):
        assert any(b <= at and at + 17 <= b + toxicity.LENGTH for b in begin.tolist())


def toxic_corpus(r, n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = sentence(r, r.randint(20, 150)).split(" ")
        for _ in range(3 if bad else 0):
            text.insert(r.randrange(len(text)), r.choice(["Blockhead!", "numskull", "qzzv" + sentence(r, 1)]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out_accuracy(spark):
    r = rng(20)
    rows, labels = toxic_corpus(r, 1500)
    extra = [(10_000 + i, t) for i, t in enumerate(awkward(r))]
    table = spark.createDataFrame([*labels, (0, 1, 0), (99_999, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows + extra), table.where(~toxicity.held_out()))
    scored = docs(spark, rows + extra).withColumn("held", toxicity.held_out())
    out = toxicity.score(scored.drop("score"), model, ["doc_id", "held"]).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= x.score <= 1 for x in out)
    held = [x for x in out if x.held and x.doc_id < 10_000]
    right = [(x.score >= 0.3) == (x.doc_id % 4 == 0) for x in held]
    assert len(held) > 200 and np.mean(right) > 0.9
    by = {x.doc_id: x.score for x in out}
    assert by[10_000] == by[10_001] == by[10_002] == model.base


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, [(1, "a b c")]), none)
    assert [x.score for x in toxicity.score(docs(spark, [(1, "a b c")]).drop("score"), model, ["doc_id"]).collect()] == [0.0]
    one = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs(spark, [(1, "a b c")]), one).base == 1.0
    assert toxicity.score(docs(spark, []).drop("score"), model, ["doc_id"]).collect() == []


# --- extraction -----------------------------------------------------------------------------


def test_trees_learn_a_step():
    r = np.random.default_rng(2)
    x = r.standard_normal((2000, 4))
    y = (x[:, 1] > 0.3).astype(int) + (x[:, 2] > 1) * (x[:, 1] > 0.3)
    trees = boosting.fit(x, y, 3, rounds=15)
    p = trees.log_probabilities(r_new := r.standard_normal((500, 4)))
    want = (r_new[:, 1] > 0.3).astype(int) + (r_new[:, 2] > 1) * (r_new[:, 1] > 0.3)
    assert (p.argmax(1) == want).mean() > 0.97 and np.allclose(np.exp(p).sum(1), 1, atol=1e-4)


def test_extraction_on_new_layouts():
    model = html_extraction.default_model()
    nodes = html_extraction.read_pages(html_layouts.pages(200, 777))
    want = html_extraction.labels(nodes)
    keep = np.array(html_extraction.decode(nodes, model.trees.log_probabilities(html_extraction.features(nodes, model.odds))))
    run = np.array([bool(t) for t in nodes.text])
    size = np.array([len(t) for t in nodes.text])
    main = (want == html_extraction.MAIN) & run
    assert size[keep & main].sum() / size[main].sum() > 0.99 and size[keep & main].sum() / size[keep & run].sum() > 0.99


def test_decoding_never_contradicts_itself():
    r = np.random.default_rng(3)
    nodes = html_extraction.read_pages(html_layouts.pages(20, 5))
    keep = html_extraction.decode(nodes, np.log(r.dirichlet([1, 1, 1], len(nodes.page))))
    for i, p in enumerate(nodes.parent):
        if p >= 0 and keep[p]:
            assert keep[i]


PAGE = (
    '<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
    '<div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div><article><h1>The &amp; title</h1><p>First  one\n here<br>and on &#233;.<p><b>Second</b> block'
    " that was never closed, with more words in it to read.<ul><li>item one</li><li>item two</li></ul></article>"
    '<section id="comments"><div class="comment"><p>I disagree with this.</p></div></section><aside class="sidebar"><a href="/x">Related</a></aside>'
    '<form><input name=q><p>Search</p></form><footer>&copy; Site</footer>'
)


def test_extraction_of_a_page(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "   "), (5, "u", "<html><body></body></html>"), (6, "u", "<div>" * 3000 + "deep"), (1, "u", PAGE), (7, "u", "a < b &am <p")]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = html_extraction.extract_text(pages, ["page_id", "url"]).collect()
    by = {x.page_id: x for x in out}
    assert len(out) == len(rows) and all(x.n_chars == len(x.text) for x in out)
    assert by[1].text == "The & title\n\nFirst one here and on é.\n\nSecond block that was never closed, with more words in it to read.\n\nitem one\n\nitem two"
    assert by[2].text == by[3].text == by[4].text == by[5].text == ""
    assert html_extraction.extract_text(pages.limit(0), ["page_id"]).collect() == []


def test_given_pages_exactly(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {x.page_id: x.text for x in html_extraction.extract_text(pages, ["page_id"]).collect()}
    for p in pages.collect():
        blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", p.html, re.S)[1])
        plain = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert got[p.page_id] == "\n\n".join(b for b in plain if b)


@pytest.mark.parametrize("page,want", [
    ("<div><button>go</div><p>one</p>", ["one"]),
    ("<div><select><option>x</div><p>one</p>", ["one"]),
    ("<div><svg><g><path/></div><p>one</p>", ["one"]),
    ("<div><noscript><div>x</div>y</div><p>one</p>", ["one"]),
    ("<div>a<noscript><div>x</div>y</noscript>b</div><p>one</p>", ["ab", "one"]),
    ("<html><head><title>t</title><meta name=x><p>one</p><p>two</p>", ["one", "two"]),
    ("<html><head><title>t</title>one<p>two</p>", ["one", "two"]),
    ("<head><title>t</title></head><body><p>one</p>", ["one"]),
    ("<head><noscript><img></noscript><link><body><p>one</p>", ["one"]),
])
def test_dropped_elements_end_with_their_parent(page, want):
    assert [t for t in html_extraction.read_pages([page]).text if t] == want


# --- decontamination ------------------------------------------------------------------------


def common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence_against_brute_force():
    r = rng(30)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = decontamination.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got.sum() == common(a, b)


def leak_corpus(r):
    items = [(i, sentence(r, r.randint(15, 60)) + ". " + sentence(r, r.randint(3, 8)) + ".") for i in range(40)]
    rows, want = [], set()
    for i in range(300):
        text = [sentence(r, r.randint(10, 120)), sentence(r, r.randint(10, 120))]
        if i % 5 == 0:
            k = r.randrange(40)
            leak = items[k][1]
            if i % 3 == 1:
                leak = leak.upper().replace(" ", "\n ")
            elif i % 3 == 2:  # a paraphrase: a sixth of the words goes or changes, the answer stays
                head, answer = leak.split(". ")[0].split(" "), leak.split(". ")[1]
                head = [w if r.random() > 1 / 6 else r.choice(["", sentence(r, 1)]) for w in head]
                leak = " ".join(head) + ". " + answer
            text.insert(1, leak)
            want.add((i, k))
        rows.append((i, " ".join(text)))
    return items, rows, want


def test_planted_leaks_and_nothing_else(spark):
    r = rng(31)
    items, rows, want = leak_corpus(r)
    table = spark.createDataFrame([(*i, "x") for i in [*items, (100, None), (101, ""), (102, "!!")]], "item_id long, text string, hits string")
    extra = [(1000 + i, t) for i, t in enumerate(awkward(r))]
    out = decontamination.with_hits(docs(spark, rows + extra), table, ["doc_id"]).collect()
    assert len(out) == len(rows) + len(extra)
    assert {(x.doc_id, h.item_id) for x in out for h in x.hits} == want


def test_item_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 7)
    items, rows, want = leak_corpus(rng(32))
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.with_hits(docs(spark, rows), table, ["doc_id"]).collect()
    assert {(x.doc_id, h.item_id) for x in out for h in x.hits} == want
    assert decontamination.with_hits(docs(spark, []), table, ["doc_id"]).collect() == []
    assert [x.hits for x in decontamination.with_hits(docs(spark, rows[:3]), table.limit(0), ["doc_id"]).collect()] == [[], [], []]


def test_latent_space_spans_the_passages(spark):
    r = rng(33)
    items = [(i, sentence(r, 20)) for i in range(12)]
    idf = np.ones(decontamination.BUCKETS)
    used, v = decontamination.latent_space(spark.createDataFrame(items, "item_id long, text string").repartition(3), idf)
    a = np.zeros((12, len(used)))
    for k, (at, w) in enumerate(decontamination._matrix([t for _, t in items], idf)):
        a[k, np.searchsorted(used, at)] = w
    assert np.allclose(a @ v @ v.T, a, atol=1e-3) and np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)


def test_passages_of_a_large_benchmark_are_near_themselves(spark):
    r = rng(34)
    items = [(i, sentence(r, r.randint(16, 50), "abcd")) for i in range(3000)]
    idf = np.log(1 + np.random.default_rng(1).random(decontamination.BUCKETS) * 1000) ** 2
    x = decontamination.index(spark, items, idf)
    texts = [t for _, t in items]
    own = []
    for s in x.spaces:
        assert len(s.of) <= decontamination.SPACE
        own += [(int(i), v, s) for i, v in zip(s.of, s.latent, strict=True)]
    matrix = [(i, m) for i, t in enumerate(texts) for m in decontamination._matrix([t], idf)]
    assert [i for i, _, _ in own] == [i for i, _ in matrix]
    assert min(float(w @ s.vectors[s.slot[at]] @ v) for (_, (at, w)), (_, v, s) in zip(matrix, own, strict=True)) > 0.99
    got = decontamination.find(x, texts)
    assert all(i in {h[0] for h in hits} for i, hits in enumerate(got))


def test_words_that_go_together_in_the_benchmark_make_candidates(spark):
    r = rng(36)
    head, answer, rare, other = ([sentence(r, 1, "abcd") + k + str(i) for i in range(n)] for k, n in (("h", 18), ("a", 6), ("r", 8), ("o", 8)))
    spread = lambda own: [w for k in range(8) for w in (*head[2 * k : 2 * k + 2], own[k])] + head[16:]
    text = lambda own: " ".join(spread(own)) + ". " + " ".join(answer) + "."
    items = [(0, text(rare)), *((1 + i, " ".join([*rare, *other, f"z{i}"])) for i in range(10))]
    items += [(100 + i, " ".join(f"f{i}x{k}" for k in range(20))) for i in range(150)]
    idf = np.ones(decontamination.BUCKETS)
    strange = [f"s{i}" for i in range(8)]
    for w in (*rare, *other, *strange):
        idf[decontamination.bucket(decontamination.words([w])[0])] = 3
    x = decontamination.index(spark, items, idf)
    got = decontamination.find(x, [text(rare), text(other), text(strange)])
    assert [h[0] for h in got[0]] == [0] and [h[0] for h in got[1]] == [0] and got[1][0][1] < decontamination.COSINE
    assert got[2] == []


@pytest.mark.parametrize("kind", ["copy", "paraphrase", "copied text"])
def test_items_that_a_third_of_the_documents_repeat(spark, kind):
    r = rng(35)
    items = [(i, sentence(r, 12, "abcd") + ". " + sentence(r, 4, "abcd") + ".") for i in range(20)]
    common, hot = [sentence(r, 1) for _ in range(3000)], []
    for i in range(300):
        leak = items[0][1] if i % 3 == 0 else ""
        if kind == "paraphrase" and leak:  # two of the first twelve words change, in each its own
            w = leak.split(" ")
            for k in r.sample(range(12), 2):
                w[k] = sentence(r, 1)
            leak = " ".join(w)
        rest = [" ".join(r.choice(common) for _ in range(r.randint(20, 90))) for _ in range(2)]
        hot.append((i, hot[0][1] if kind == "copied text" and leak and hot else " ".join([rest[0], leak, rest[1]])))
    out = decontamination.with_hits(docs(spark, hot), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    assert {(x.doc_id, h.item_id) for x in out for h in x.hits} == {(i, 0) for i in range(0, 300, 3)}


def test_words_that_repeat_the_benchmark(spark):
    grams = decontamination.benchmark_grams(spark.createDataFrame([(1, "a b c d e f g h i"), (2, "x y")], "item_id long, text string"))
    texts = ["q a B c. r d e f g s s s s s h i j", "a b", None, "c x y", "a b c"]
    h, begin = decontamination.words(texts)
    got = decontamination._repeats_benchmark(h, begin, grams)
    assert "".join("01"[int(v)] for v in got) == "0" + "1" * 8 + "0" * 8 + "00" + "000" + "111"
    assert not decontamination.benchmark_grams(spark.createDataFrame([(1, "x y")], "item_id long, text string")).any()


# --- licences -------------------------------------------------------------------------------


def files(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, license string")


def test_licenses_and_inheritance(spark):
    r = rng(40)
    rows = [
        (1, "a/LICENSE", "Some words.\nReleased under the MIT License.\n"),
        (2, "a/b/c/main.py", sentence(r, 30)),
        (3, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/c/d/x.py", sentence(r, 9) + ". Licensed under the Apache License, Version 2.0. " + sentence(r, 5)),
        (5, "z/free.py", sentence(r, 9)),
        (6, "a/b.py", None),
        (7, "a/bc/x.py", ""),
        (8, None, "Licensed under CC BY-NC 4.0."),
        (9, None, "nothing"),
        (2, "a/b/c/main.py", sentence(r, 30)),
        (10, "top.txt", "mit der under the"),
    ]
    out = {x.doc_id: (x.license, x.how, x.from_path) for x in licenses.scan(files(spark, rows), ["doc_id"]).collect()}
    assert out == {
        1: ("MIT", "own", "a/LICENSE"), 2: ("GPL-3.0", "inherited", "a/b/COPYING"), 3: ("GPL-3.0", "own", "a/b/COPYING"), 4: ("Apache-2.0", "own", "a/b/c/d/x.py"),
        5: (None, "none", None), 6: ("MIT", "inherited", "a/LICENSE"), 7: ("MIT", "inherited", "a/LICENSE"), 8: (None, "none", None), 9: (None, "none", None), 10: (None, "none", None),
    }
    assert licenses.scan(files(spark, rows), ["doc_id"]).count() == len(rows)
    assert licenses.scan(files(spark, []), ["doc_id"]).collect() == []


def test_notices_that_a_third_of_the_files_have(spark):
    r = rng(41)
    hot = {1: "Released under the MIT License.", 2: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."}
    rows = [(i, f"d{i}/x.py", sentence(r, 8) + ".\n" + hot.get(i % 3, sentence(r, 8)) + "\n" + sentence(r, 8)) for i in range(120)]
    out = {x.doc_id: x.license for x in licenses.scan(files(spark, rows), ["doc_id"]).collect()}
    assert out == {i: {0: None, 1: "MIT", 2: "BSD-3-Clause"}[i % 3] for i in range(120)}


def test_segments_without_a_cue_are_far_from_all_templates():
    r = rng(42)
    postings = [(i, name, w, n) for i, (name, text) in enumerate(licenses.TEMPLATES) for w, n in Counter(text.lower().split()).items()]
    for _ in range(20):
        weight = {w: r.choice([0, 0.1, 1, 5]) * r.random() for _, _, w, _ in postings}
        cues = set(licenses.cue_words(postings, weight))
        for k in range(len(licenses.TEMPLATES)):
            own = {w: n * weight[w] for t, _, w, n in postings if t == k}
            length = sum(v * v for v in own.values()) ** 0.5
            rest = sum(v * v for w, v in own.items() if w not in cues) ** 0.5
            assert not length or rest / length < licenses.MIN_COSINE


@pytest.mark.parametrize("name,text", licenses.TEMPLATES)
def test_each_template_is_its_own_nearest(name, text):
    import re

    bag = lambda t: re.findall("[a-z0-9]+(?:[.][0-9]+)*", t.lower())
    assert bag(text) and [n for n, t in licenses.TEMPLATES if sorted(bag(t)) == sorted(bag(text))] == [name]


def test_plans_have_no_python(spark):
    from sortbox.llm import queries

    for name in ("op5_license_scan", "op9_sampled_splitter_shards"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow", "BatchEval"))
