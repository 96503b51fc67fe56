import re

import pytest
from pyspark.sql import functions as F

from slidemill.llm import licenses
from slidemill.llm.common import table

MIT = "\n".join(licenses.SENTENCES[k][0] + "." for k in ("mit-title", "mit-grant", "mit-notice", "asis-software", "no-liability"))


def test_rules():
    wrapped = "\n".join(" * " + line for line in re.sub(r"(.{60}\S*) ", r"\1\n", MIT).split("\n"))
    for text in (MIT, wrapped, "Some words before\n" + wrapped + "\nand after."):
        assert [n for n, _, _ in licenses.scan_text(text)[1]] == ["MIT"]
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n'
    ids, found = licenses.scan_text(apache)
    assert [n for n, _, _ in found] == ["Apache-2.0"] and "apache2-copy" in ids
    assert licenses.scan_text("Copyright (c) 2020 A. Body\nAll rights reserved.")[1] == []
    assert licenses.scan_text("Licensed under CC BY-NC 4.0.")[1] == [("CC-BY-NC-4.0", 0, 27)]
    ids = ["mit-short", "gnu-free", "gnu general terms 3", "gnu-useful", "gnu-implied", "copyright", "gnu general see", "mit-short"]
    assert [m[0] for m in licenses.match(ids)] == ["MIT", "GPL-3.0-or-later", "MIT"]


def test_against_plain_search(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lines = {
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "MIT": "Released under the MIT License.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    }
    got = {r.doc_id: r.licenses for r in licenses.digest(licenses.scan(docs)).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == ",".join(sorted(k for k, v in lines.items() if v in r.text)), r.doc_id


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License"), (3, "\n" * 50_000 + "MIT License"), (1, None), (4, "this " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("found"), F.lit("x").alias("Text"))
    out = licenses.digest(licenses.scan(df)).collect()
    assert len(out) == 6 and sorted(r.licenses for r in out) == ["", "", "", "", "", "MIT"]
    assert licenses.scan(df.limit(0)).count() == 0


def test_indents_marks_and_many_lines():
    names = lambda text: [n for n, _, _ in licenses.scan_text(text)[1]]
    for before in (" " * 50, "\t" * 60, "(", "[", "| ", "= ", "“", "﻿", "*" * 70 + " "):
        assert names(f"Words.\n{before}Licensed under the MIT License)\nwords") == ["MIT"], before
    for width, gap in ((30, "\n"), (60, "\n\n"), (10, "\n" * 40), (1, "\n // ")):
        wrapped = re.sub(rf"([^\n]{{{width}}}\S*) ", lambda m, gap=gap: m[1] + gap, MIT)
        assert wrapped.count("\n") > 12 and names(wrapped) == ["MIT"]
        assert licenses.scan_text(wrapped)[0] == ["mit-title", "mit-grant", "mit-notice", "asis-software", "no-liability"]
    gnu = "This work is distributed under the terms of the GNU Lesser General Public License as published by the Free Software Foundation version 3.0 or later"
    assert names(gnu.replace(" ", "\n\n")) == ["LGPL-3.0-or-later"] and names("Licenſed") == []
    assert names("This is\n" * 20_000 + "MIT.\nReleased under the MIT\n.\nLicense") == []


def test_notices_and_short_forms():
    names = lambda text: [n for n, _, _ in licenses.scan_text(text)[1]]
    gnu = """This {w} is free software{a} you can redistribute it and/or modify
it under the terms of the GNU {n} Public License as published by
the Free Software Foundation{b} either version {v} of the License, or
(at your option) any later version.

This {w} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {n} Public License for more details.

You should have received a copy of the GNU {n} Public License
along with this {w}."""
    for w, n, v, want in (("program", "General", "3", "GPL-3.0"), ("program", "General", "2", "GPL-2.0"), ("library", "Lesser General", "2.1", "LGPL-2.1"), ("library", "Lesser General", "3", "LGPL-3.0"), ("program", "Affero General", "3", "AGPL-3.0"), ("library", "Library General", "2", "LGPL-2.0")):
        for a, b in ((":", ","), (";", ";")):
            text = gnu.format(w=w, n=n, v=v, a=a, b=b)
            assert licenses.scan_text(text)[1] == [(want + "-or-later", 0, len(text) - 1)], (text, licenses.scan_text(text))
            assert names("// " + text.replace("\n", "\n// ")) == [want + "-or-later"]
    for text, want in {
        "Licensed under the GNU GPL": None,
        "Licensed under the GNU General Public License version 2 or later.": "GPL-2.0-or-later",
        "Licensed under the GNU General Public License v2.0 only": "GPL-2.0",
        "Distributed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "Released under the GNU Affero General Public License v3.0 or any later version": "AGPL-3.0-or-later",
        "Licensed under CC0 1.0 Universal": "CC0-1.0",
        "This work is licensed under CC BY-SA 2.0.": "CC-BY-SA-2.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 2.5 Generic License": "CC-BY-NC-ND-2.5",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
        "Licensed under the Mozilla Public License, version 1.1": "MPL-1.1",
        "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
        "This program and the accompanying materials\nare made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution": "EPL-1.0",
        "Licensed under the ISC License": "ISC",
        "Licensed under the BSD 3-Clause License": "BSD-3-Clause",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
    }.items():
        assert names(text) == ([want] if want else []), (text, licenses.scan_text(text))
        if "\n" not in text:
            assert names(text.replace(" ", "\n# ")) == ([want] if want else []), text


def test_every_rule_finds_its_own_sentences():
    known = {**{k: v[0] for k, v in licenses.SENTENCES.items()}}
    for licence, rule in licenses.RULES:
        if all(k in known for k in rule):
            text = ".\n".join(known[k] for k in rule) + "."
            ids, found = licenses.scan_text(text)
            assert ids == rule and [n for n, _, _ in found] == [licence], (licence, rule, ids, found)


SHORT = {
    "SPDX-License-Identifier: MIT": ["MIT"],
    "// SPDX-License-Identifier: GPL-2.0-only OR Apache-2.0": ["GPL-2.0", "Apache-2.0"],
    "# spdx-license-identifier: (LGPL-2.1-or-later AND BSD-3-Clause) */": ["LGPL-2.1-or-later", "BSD-3-Clause"],
    "SPDX-License-Identifier: GPL-3.0+": ["GPL-3.0-or-later"],
    "SPDX-License-Identifier: NoSuch-1.0": [],
    "This project is licensed under the MIT License.": ["MIT"],
    "Licensed under MIT": ["MIT"],
    "Licensed under the Apache License 2.0": ["Apache-2.0"],
    "Released under the Apache License, Version 2.0.": ["Apache-2.0"],
    "Distributed under the GPLv3": ["GPL-3.0"],
    "Licensed under the GNU LGPL v2.1 or later": ["LGPL-2.1-or-later"],
    "Licensed under the GNU General Public License version 2.1": [],
    "Licensed under the GNU Affero General Public License version 2": [],
    "Licensed under the GNU Lesser General Public License v1": [],
}


@pytest.mark.parametrize("text", SHORT)
def test_short_forms_and_declared_identifiers(text):
    found = licenses.scan_text(f"Some code.\n\n{text}\n\nMore of it under way, with all rights.")[1]
    assert [f[0] for f in found] == SHORT[text]


def test_only_licences_that_exist():
    gnu = {n for n, _ in licenses.RULES if "GPL" in n}
    assert gnu == {f"{n}{t}" for n in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for t in ("", "-or-later")}
