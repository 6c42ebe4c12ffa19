"""Licence scan: whole texts, wrapped notices, names, notices that many files have, long texts."""

import pytest

from sortbox.llm import licenses

from .helpers import rng, sentence

BSD2 = """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
THIRD = """
3. Neither the name of Foo Labs nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.
"""
MIT = """The MIT License

Copyright 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so."""
APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
GNU = """/*
 * This {what} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {kind}
 * Public License as published by the Free Software Foundation; either
 * version {v} of the License, or (at your option) any later version.
 */
int main(void);"""
WANT = {
    "bsd2": (BSD2.format(third=""), "BSD-2-Clause"),
    "bsd3": (BSD2.format(third=THIRD), "BSD-3-Clause"),
    "mit": (MIT, "MIT"),
    "apache": (APACHE, "Apache-2.0"),
    "lgpl": (GNU.format(what="library", kind="Lesser General", v="2.1"), "LGPL-2.1"),
    "lgpl3": (GNU.format(what="library", kind="Lesser General", v="3"), "LGPL-3.0"),
    "gpl2": (GNU.format(what="program", kind="General", v="2"), "GPL-2.0"),
    "gpl3": (GNU.format(what="program", kind="General", v="3"), "GPL-3.0"),
    "agpl": (GNU.format(what="program", kind="Affero General", v="3"), "AGPL-3.0"),
    "spdx": ("# SPDX-License-Identifier: MIT\nimport os\n", "MIT"),
    "spdx2": ("// SPDX-License-Identifier: GPL-2.0-or-later\n#include <x.h>", "GPL-2.0"),
    "spdx3": ("// SPDX-License-Identifier: CC-BY-SA-4.0\n", "CC-BY-SA-4.0"),
    "other": ("// SPDX-License-Identifier: Foo-Bar\nint x;", None),
    "unsaid": ("This work is licensed under the GNU General Public License.", None),
    "both": ("Licensed under the MIT License. Or: Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    "short": ("mit der", None),
    "word": ("a lab of the mit had some public version 2.0 of it, and a license was general in 1999", None),
}


def own(spark, rows):
    out = licenses.own_licenses(spark.createDataFrame(rows, "path string, text string")).collect()
    assert len({r.path for r in out}) == len(out)
    return {r.path: r.license for r in out}


def test_texts_notices_and_names(spark):
    got = own(spark, [(k, t) for k, (t, _) in WANT.items()])
    assert {k: got.get(k) for k in WANT} == {k: w for k, (_, w) in WANT.items()}


def test_notices_with_extra_words_in_any_share_of_the_files(spark):
    r = rng(50)
    notice = "/* Licensed under the MIT License, see LICENSE */\n"
    for share in (1, 3, 100):
        rows = [(f"f{i}", sentence(r, 9) + ".\n" + (notice if i % share == 0 else "") + sentence(r, 9)) for i in range(100)]
        assert own(spark, rows) == {f"f{i}": "MIT" for i in range(0, 100, share)}


def test_a_notice_is_found_at_every_place_of_a_long_text(spark):
    r = rng(51)
    body = sentence(r, 3000).replace(".", " ").split()
    at = [0, 1, 350, 400, 420, 425, 430, 511, 512, 513, 850, 1500, 2990, 3000]
    rows = [(f"t{k}", " ".join(body[:k] + ["Licensed under the\n * Apache License,", "Version 2.0."] + body[k:])) for k in at]
    rows += [("plain", " ".join(body)), ("many", "Released under the MIT License. " * 2000), ("empty", ""), ("null", None)]
    assert own(spark, rows) == {f"t{k}": "Apache-2.0" for k in at} | {"many": "MIT"}


@pytest.mark.parametrize("tile", [300])
def test_tiles_change_no_cosine(spark, monkeypatch, tile):
    r = rng(52)
    rows = [(k, sentence(r, 40) + " " + t + " " + sentence(r, 200) + " " + t) for k, (t, _) in WANT.items()]
    df = spark.createDataFrame(rows, "path string, text string")
    want = sorted(map(tuple, licenses.own_licenses(df).collect()))
    monkeypatch.setattr(licenses, "TILE", tile)
    assert sorted(map(tuple, licenses.own_licenses(df).collect())) == want and want
