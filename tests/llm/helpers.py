"""Small inputs and brute-force versions for the corpus operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, words int, kept string"


def docs(spark, rows):
    """Documents (id, text[, lang[, source]]) with extra columns whose names clash with results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), "x", 1, "no") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward(rng):
    """Texts of the kinds that break tokenisers."""
    return [None, "", " \n\t ", "x", "é ü ß 漢字 😀", "a\x00b   c d", "w " * 3000, sentence(rng, 4000), "same same", "same same", "LOUD!! loud!!", "\n\na b\n\na b\n"]


def rng(seed=1):
    return random.Random(seed)
