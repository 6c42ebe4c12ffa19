"""Licence scan: TF-IDF cosine of notices to templates, then inheritance along directories.

DataFrame functions only.  Words are [a-z0-9] with dotted numbers, lower-cased; lines, punctuation and
comment marks do not count, so a notice may be wrapped over lines.  A word weighs
``FLOOR`` + ln((1 + licences) / (1 + licences with it in a template)); words of no template weigh most.  These
weights are the templates' own, so a notice is found alike in one file and in every file.

A template is compared with windows of the text that have as many words as it has itself (fewer at the
ends of a text, at least half).  They lie so that one of the template's cue words falls on its own
place.  The common and then the lightest words of a template that together make up less than ``MIN_COSINE`` of
its length are no cues, its others are: a window without a cue cannot reach that cosine.  A licence is a file's own
by its best window of ``MIN_COSINE`` or more; templates of whole texts (``WHOLE``) count before notices
and names.A window must have all numbers of its template: a GNU
licence without a version is none of them.  Equal cosines are ranked by name.
A file without a licence takes that of the licence files in the nearest directory
above or beside it; several of them in a directory are ranked by kind, cosine, then name, then path.

Texts are read once and compared in tiles of ``TILE`` words that overlap by the longest template, so
rows stay small however long a text is.  Null and empty texts have no own licence but inherit.  Rows
with the same path are one file to the scan; each row is returned.  A row without a path is no file: it
is returned without a licence.  An empty table gives an empty result; columns other than the named ones
are neither read nor returned.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_COSINE = 0.7
FLOOR = 0.3
TILE = 512
# Words that most texts have: no cues as long as the bound allows.
COMMON = (
    "a", "all", "and", "any", "are", "as", "at", "be", "but", "by", "can", "do", "each", "for", "from", "have", "if", "in", "is", "it", "its",
    "may", "no", "not", "of", "on", "or", "other", "so", "such", "that", "the", "their", "this", "to", "under", "use", "was", "who", "with", "you",
)
WORD = "[a-z0-9]+(?:[.][0-9]+)*"
LICENSE_FILE = "(?i)^(licen[sc]e|copying|notice|unlicense)"

# Notices as their licences word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
]
# Whole texts, as far as they tell licences with the same opening apart.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY"
WHOLE = [
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _AS_IS),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def template_rows(templates: list[tuple[str, str]] | None = None) -> list[tuple[str, str, bool]]:
    """(licence, text, whole) of all templates, with the SPDX line of each licence."""
    if templates is not None:
        return [(name, text, False) for name, text in templates]
    names = sorted({name for name, _ in TEMPLATES})
    spdx = [(name, f"SPDX-License-Identifier: {name}", False) for name in names]
    return [(name, text, False) for name, text in TEMPLATES] + spdx + [(name, text, True) for name, text in WHOLE]


def word_weights(rows: list[tuple[str, str, bool]]) -> tuple[dict[str, float], float]:
    """The weight of each template word, and that of any other word."""
    licences = {name for name, _, _ in rows}
    having: dict[str, set[str]] = {}
    for name, text, _ in rows:
        for w in re.findall(WORD, text.lower()):
            having.setdefault(w, set()).add(name)
    weigh = lambda n: FLOOR + math.log((1 + len(licences)) / (1 + n))
    return {w: weigh(len(n)) for w, n in having.items()}, weigh(0)


def cue_words(postings: list[tuple[int, str, str, int]], weight: dict[str, float]) -> list[str]:
    """Words of which a segment has one if its cosine to a template is ``MIN_COSINE`` or more."""
    cues: set[str] = set()
    for template in {t for t, _, _, _ in postings}:
        parts = sorted((w not in COMMON, weight[w], w, (n * weight[w]) ** 2) for t, _, w, n in postings if t == template)
        # The cosine is at most the share of the template's length in the words it has with a
        # segment; a little less is asked for, as cosines are rounded.
        least, left = (MIN_COSINE - 1e-5) ** 2 * sum(p for *_, p in parts), 0.0
        for _, _, w, p in parts:
            left += p
            if left >= least:
                cues.add(w)
    return sorted(cues)


def _cue_table(spark: SparkSession, rows: list[tuple[str, str, bool]], weight: dict[str, float]) -> tuple[list[str], int, DataFrame]:
    """All cue words, the longest template, and (word, place, template columns): as many rows as the templates have cues."""
    texts = [re.findall(WORD, text.lower()) for _, text, _ in rows]
    postings = [(t, rows[t][0], w, n) for t, ws in enumerate(texts) for w, n in sorted(Counter(ws).items())]
    out = []
    for t, ws in enumerate(texts):
        own = [p for p in postings if p[0] == t]
        cues = set(cue_words(own, weight))
        heavy = [(w, n * weight[w]) for _, _, w, n in own]
        numbers = sorted({w for w in ws if w[0].isdigit()})
        norm = math.sqrt(sum(v * v for _, v in heavy))
        out += [(w, place, rows[t][0], int(rows[t][2]), len(ws), norm, numbers, heavy) for place, w in enumerate(ws) if w in cues]
    fields = "word:string,place:int,license:string,whole:int,size:int,t_norm:double,numbers:array<string>,heavy:array<struct<word:string,v:double>>"
    names = ("word", "place", "license", "whole", "size", "t_norm", "numbers", "heavy")
    out_rows = [dict(zip(names, (*r[:-1], [{"word": w, "v": v} for w, v in r[-1]]), strict=True)) for r in out]
    # A literal table: its rows are bounded by the templates, and no Python worker reads it.
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(out_rows)), f"array<struct<{fields}>>")))
    return sorted({r[0] for r in out}), max(map(len, texts)), table


def own_licenses(files: DataFrame, templates: list[tuple[str, str]] | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """``path``, ``license``, ``whole`` (1 if by a whole text) and ``cosine`` of files with a notice of their own."""
    spark = files.sparkSession
    rows = template_rows(templates)
    weight, other = word_weights(rows)
    cues, longest, table = _cue_table(spark, rows, weight)
    step = max(TILE - longest, longest)
    is_cue = lambda w: w.isin(cues)

    read = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where("path is not null")
    # explode(array(x)) keeps the optimizer from computing x again wherever it is named.
    once = lambda x: F.explode(F.array(x))
    read = read.select("path", once(words(F.col("text"))).alias("words")).where(F.exists("words", is_cue))
    # A tile owns the windows that begin in its first ``step`` words; the first also those cut by the text's beginning.
    cut = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(step)), lambda at: F.struct((at == 0).alias("first"), F.slice("words", at + 1, F.lit(step + longest)).alias("words")))
    tiles = read.select("path", once(cut).alias("t")).select("path", F.explode("t").alias("t")).select("path", "t.first", F.col("t.words").alias("words"))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda at: is_cue(F.col("words")[at]))
    found = tiles.select("path", "first", "words", once(places).alias("places")).select("path", "first", "words", F.explode("places").alias("at"))
    found = found.withColumn("word", F.col("words")[F.col("at")])
    found = found.join(F.broadcast(table), "word").withColumn("begin", F.col("at") - F.col("place")).where((F.col("begin") < step) & (F.col("first") | (F.col("begin") >= 0)))
    window = F.slice("words", F.greatest("begin", F.lit(0)) + 1, F.col("size") + F.least("begin", F.lit(0)))
    found = found.select("path", "license", "whole", "size", "t_norm", "numbers", "heavy", once(window).alias("window"))
    found = found.where((2 * F.size("window") >= F.col("size")) & (F.size(F.array_except("numbers", "window")) == 0))
    # The template's length in the words it shares with the window bounds the cosine.
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    shared = F.filter("heavy", lambda h: F.array_contains("window", h["word"]))
    found = found.withColumn("shared", once(shared)).where(F.sqrt(add(F.transform("shared", lambda h: h["v"] * h["v"]))) >= (MIN_COSINE - 1e-5) * F.col("t_norm"))
    weights = F.create_map(*(F.lit(x) for pair in sorted(weight.items()) for x in pair))
    parts = F.transform(F.array_distinct("window"), lambda u: F.struct(u.alias("word"), (F.size(F.filter("window", lambda x: x == u)) * F.coalesce(F.try_element_at(weights, u), F.lit(other))).alias("v")))
    found = found.withColumn("parts", once(parts))
    dot = add(F.transform("shared", lambda h: h["v"] * F.filter("parts", lambda p: p["word"] == h["word"])[0]["v"]))
    cosine = F.round(dot / (F.sqrt(add(F.transform("parts", lambda p: p["v"] * p["v"]))) * F.col("t_norm")), 6)
    scored = found.select("path", "license", "whole", cosine.alias("cosine")).where(F.col("cosine") >= MIN_COSINE)
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("whole")).alias("k"), (-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.k")).alias("whole"), (-F.col("b.c")).alias("cosine"))


def scan(files: DataFrame, keep: list[str], templates: list[tuple[str, str]] | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """``keep`` columns, ``path``, ``license``, ``how`` (own, inherited, none), ``cosine``, ``from_path``."""
    own = own_licenses(files, templates, path, text)
    rows = files.select(*keep, F.col(path).alias("path"))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    given = own.where(name.rlike(LICENSE_FILE)).withColumn("folder", folder)
    given = given.groupBy("folder").agg(F.min(F.struct((-F.col("whole")).alias("k"), (-F.col("cosine")).alias("c"), "license", "path")).alias("g")).where("folder is not null")
    # Each directory once, with all directories above it; the deepest that has a licence counts.
    folders = rows.select(folder.alias("below")).where("below is not null").distinct()
    parts = F.split("below", "/")
    above = folders.select("below", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select("below", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("folder"))
    inherited = above.join(given, "folder").groupBy("below").agg(F.max_by("g", "depth").alias("g"))
    out = rows.withColumn("below", folder).join(own, "path", "left").join(inherited, "below", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        *keep,
        "path",
        F.coalesce("license", "g.license").alias("license"),
        F.when(mine, "own").when(F.col("g").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.coalesce("cosine", -F.col("g.c")).alias("cosine"),
        F.when(mine, F.col("path")).otherwise(F.col("g.path")).alias("from_path"),
    )
