"""Licence scans by sentence rules: normalised sentences become identifiers, ordered rules match their sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import pick

#: Known licence sentences, by identifier. They are compared after normalise().
SENTENCES = {
    "apache2-short": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0"],
    "apache2-notice": ['Licensed under the Apache License, Version 2.0 (the "License")', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'],
    "apache2-comply": ["You may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-asis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit-short": ["Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License"],
    "mit-title": ["MIT License", "The MIT License (MIT)", "The MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "asis-software": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "no-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "gnu-free": ["This program is free software", "This library is free software", "This file is free software", "This software is free software", "It is free software"],
    "gnu-useful": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gnu-implied": ["Without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-short": ["Released under the ISC License", "Licensed under the ISC License", "This work is licensed under the ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "public-domain": ["This work is in the public domain"],
    "all-rights": ["All rights reserved"],
}
#: The licences of GNU by name, and their versions as notices write them.
GNU = {"general": ("GPL", "2", "3"), "lesser general": ("LGPL", "2.1", "3"), "library general": ("LGPL", "2"), "affero general": ("AGPL", "3")}
for _name, (_, *_versions) in GNU.items():
    _terms = f"You can redistribute it and/or modify it under the terms of the GNU {_name} Public License as published by the Free Software Foundation"
    SENTENCES[f"gnu {_name} terms"] = [_terms]
    SENTENCES[f"gnu {_name} see"] = [f"See the GNU {_name} Public License for more details"]
    SENTENCES[f"gnu {_name} copy"] = [f"You should have received a copy of the GNU {_name} Public License along with this {w}" for w in ("program", "library")]
    for _v in _versions:
        SENTENCES[f"gnu {_name} terms {_v}"] = [f"{_terms}, either version {_v} of the License, or (at your option) any later version"]
        SENTENCES[f"either {_v}"] = [f"Either version {_v} of the License, or (at your option) any later version"]
#: Names of parts of Creative Commons licences, and their versions.
PARTS = {"attribution": "by", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd", "noderivs": "nd"}
CC_KINDS, CC_VERSIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")
_under = r"(?:this \w+ is )?(?:licensed|released|distributed|available) under (?:the |a )?(?:terms of the )?"
_gnu = _under + r"gnu (general|lesser general|library general|affero general) public license(?: as published by the free software foundation)? v(?:ersion )?(\d)(?: 0|( 1))?"
#: Sentences with parts that vary, as patterns over normalised text and the identifier they give.
PATTERNS = [
    (r"copyright (?:c )?\d{4}(?: \d{4})*(?: .*)?|copyright c .*", "copyright"),
    (_gnu + r"(?: or any later(?: version)?| or later(?: version)?| or newer)", "gnu {0} {1}{2} or later"),
    (_gnu + r"(?: only)?", "gnu {0} {1}{2}"),
    (_under + r"(?:creative commons|cc) ((?:by|attribution)(?: nc| noncommercial)?(?: sa| nd| sharealike| noderivatives| noderivs)?) (\d) (\d)(?: international| unported| generic)?(?: public)?(?: license)?", "cc {0} {1}.{2}"),
    (_under + r"(?:creative commons 0|creative commons zero|cc0|cc 0|cc zero)(?: v(?:ersion )?)?(?: 1 0)?(?: universal)?(?: license)?", "cc0"),
    (_under + r"mit license|(?:this \w+ is )?(?:licensed|released|distributed|available) under mit", "mit-short"),
    (_under + r"apache(?: license)? (?:v|version )?2(?: 0)?(?: license)?", "apache2-short"),
    (_under + r"(?:gnu )?(gpl|lgpl|agpl) ?v?(?:ersion )?(\d)(?: 0|( 1))?(?: license)?(?: or any later(?: version)?| or later(?: version)?| or newer)", "letters {0} {1}{2} or later"),
    (_under + r"(?:gnu )?(gpl|lgpl|agpl) ?v?(?:ersion )?(\d)(?: 0|( 1))?(?: only)?(?: license)?", "letters {0} {1}{2}"),
    (_under + r"(?:simplified |new |revised )?bsd ([23]) clause license", "bsd {0} short"),
    (_under + r"mozilla public license v(?:ersion )?(\d) (\d)", "mpl {0}.{1}"),
    (r"(?:this \w+ is |this program and the accompanying materials are )?(?:made )?(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?eclipse public license v(?:ersion )?(\d) 0(?: which accompanies this distribution)?", "epl {0}.0"),
]


def _gnu_rules() -> Iterator[tuple[str, list[str]]]:
    """Notices of the GNU licences, longest first; their version ends the sentence or stands in one of its own."""
    for name, (short, *versions) in GNU.items():
        for v in versions:
            licence = f"{short}-{v if '.' in v else v + '.0'}-or-later"
            for head in ([f"gnu {name} terms {v}"], [f"gnu {name} terms", f"either {v}"]):
                after = ["gnu-useful", "gnu-implied", f"gnu {name} see", f"gnu {name} copy"]
                for n in (4, 3, 2, 0):
                    yield licence, ["gnu-free", *head, *after[:n]]
                yield licence, head


#: The versions that the GNU licences have, as normalised text writes them.
GNU_VERSIONS = {"general": ("1", "2", "3"), "lesser general": ("2 1", "3"), "library general": ("2",), "affero general": ("3",)}


def _gnu_short() -> Iterator[tuple[str, list[str]]]:
    """One sentence with the licence's name, or its letters, and version."""
    for name, versions in GNU_VERSIONS.items():
        for v in versions:
            licence = f"{GNU[name][0]}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            for what in (f"gnu {name} {v}", f"letters {GNU[name][0].lower()} {v}"):
                yield f"{licence}-or-later", [f"{what} or later"]
                yield licence, [what]


#: Rules in order; each licence's sequence of sentence identifiers. Earlier rules claim sentences first.
RULES = [
    ("Apache-2.0", ["apache2-notice", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-see"]),
    ("Apache-2.0", ["apache2-notice", "apache2-copy", "apache2-asis", "apache2-see"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "asis-software", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "asis-software", "no-liability"]),
    *_gnu_rules(),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("Apache-2.0", ["apache2-short"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-short"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("Unlicense", ["unlicense-free"]),
    *_gnu_short(),
    *[(f"CC-{k.upper().replace(' ', '-')}-{v}", [f"cc {k} {v}"]) for k in CC_KINDS for v in CC_VERSIONS],
    ("CC0-1.0", ["cc0"]),
    ("BSD-2-Clause", ["bsd 2 short"]),
    ("BSD-3-Clause", ["bsd 3 short"]),
    *[(f"MPL-{v}", [f"mpl {v}"]) for v in ("1.0", "1.1", "2.0")],
    *[(f"EPL-{v}", [f"epl {v}"]) for v in ("1.0", "2.0")],
    ("public-domain", ["public-domain"]),
]
#: A declared identifier is a sentence too, "spdx mit"; so is each one of an expression. Only licences that the rules have.
_declared = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]{1,300})", re.IGNORECASE)
_declared_one = re.compile(r"[A-Za-z0-9.+-]+")
SPDX = {k: name for name in dict(RULES) if name != "public-domain" for k in (name.lower(), f"{name.lower()}-only", f"{name.lower().removesuffix('-or-later')}+" if name.endswith("-or-later") else name.lower())}
RULES += [(name, [f"spdx {name}"]) for name in dict.fromkeys(SPDX.values())]
_gaps = re.compile(r"[^a-z0-9]+")
_edge = re.compile(r"[.!?;:]+(?=\s|$)|\n", re.MULTILINE)
_patterns = [(re.compile(p), name) for p, name in PATTERNS]
#: All that normalise() can make a word of, the signs whose lower case begins with i and k included.
_first = re.compile("[A-Za-z0-9\u0130\u212a]+")
#: What can still grow into a match of PATTERNS: the longest has 24 words after "under".
_verb = r"(?:made )?(?:licensed|released|distributed|available)(?: under(?: \w+){0,24})?"
_open = re.compile(rf"copyright(?: c)?|this(?: \w+(?: is(?: {_verb})?)?)?|this program(?: and(?: the(?: accompanying(?: materials(?: are(?: (?:made|{_verb}))?)?)?)?)?)?|made|{_verb}")


def normalise(sentence: str) -> str:
    """Lower-cased words of letters a to z and digits, one space between them; comment marks and punctuation go."""
    return _gaps.sub(" ", sentence.lower()).strip()


KNOWN = {normalise(s): name for name, all_ in SENTENCES.items() for s in all_}
#: Known sentences and what they begin with, by whole words.
BEGUN = {" ".join(words[:n]) for words in (k.split(" ") for k in KNOWN) for n in range(1, len(words) + 1)}
#: First words of what can be known: a sentence or line that begins otherwise is passed over without a lookup.
STARTS = {k.split(" ", 1)[0] for k in KNOWN} | {"copyright", "this", "made", "licensed", "released", "distributed", "available"}


def identify(sentence: str) -> str | None:
    """The identifier of a normalised sentence."""
    if (name := KNOWN.get(sentence)) is not None:
        return name
    for pattern, name in _patterns:
        if m := pattern.fullmatch(sentence):
            return name.format(*(" ".join(PARTS.get(w, w) for w in (g or "").split(" ")) for g in m.groups()))
    return None


def sentences(text: str) -> Iterator[tuple[str, int, int]]:
    """Identifier, start and end of each known sentence: a fragment, or some in a row that only line ends and blank lines part; as many as make the longest known sentence."""
    at, parts = 0, []  # start, end, if line ends alone close it, first word; none without a word
    for m in [*_edge.finditer(text), None]:
        stop, soft = (m.start(), m[0] == "\n") if m else (len(text), False)
        if word := _first.search(text, at, stop):
            parts.append([at, stop, soft, normalise(word[0]).split(" ", 1)[0]])
        elif parts and not soft:
            parts[-1][2] = False
        at = m.end() if m else stop
    i = 0
    while i < len(parts):
        acc, used, best = "", 0, None
        for j in range(i, len(parts)):
            a, b, soft, word = parts[j]
            if j == i and word not in STARTS:
                break
            acc = f"{acc} {normalise(text[a:b])}".strip()
            if (name := identify(acc)) is not None:
                best, used = (name, b), j - i + 1
            if not soft or not (acc in BEGUN or _open.fullmatch(acc)):
                break
        if best:
            yield best[0], parts[i][0] + (len(text[parts[i][0] : best[1]]) - len(text[parts[i][0] : best[1]].lstrip())), best[1]
        i += max(1, used)


def declared(text: str) -> Iterator[tuple[str, int, int]]:
    """Identifier, start and end of each licence that an SPDX line declares."""
    for line in _declared.finditer(text):
        for one in _declared_one.finditer(line[1]):
            if name := SPDX.get(one[0].lower()):
                yield f"spdx {name}", line.start(1) + one.start(), line.start(1) + one.end()


def match(ids: list[str]) -> list[tuple[str, int, int]]:
    """Licence, first and last place of each match of a rule, in order of place. Copyright lines and "all rights reserved" between a rule's sentences are passed over."""
    solid = [i for i, name in enumerate(ids) if name not in ("copyright", "all-rights")]
    free, out = [True] * len(solid), []
    for licence, rule in RULES:
        k = 0
        while k + len(rule) <= len(solid):
            if all(free[k : k + len(rule)]) and [ids[i] for i in solid[k : k + len(rule)]] == rule:
                free[k : k + len(rule)] = [False] * len(rule)
                out.append((licence, solid[k], solid[k + len(rule) - 1]))
                k += len(rule)
            else:
                k += 1
    return sorted(out, key=lambda m: m[1])


FOUND = "array<struct<license:string,start:int,stop:int>>"


def scan_text(text: str | None) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Sentence identifiers in order, and the licences with their spans in code points."""
    found = sorted([*sentences(text or ""), *declared(text or "")], key=lambda f: f[1])
    ids = [name for name, _, _ in found]
    return ids, [(licence, found[a][1], found[b][2]) for licence, a, b in match(ids)]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (array), found (array of license, start, stop) of every row of docs(doc_id, text), whole texts.

    Null and empty texts have none. Repeated rows and null ids are kept; an empty table gives an empty
    result; other columns are ignored whatever their names. A sentence stands between line ends or marks
    `.!?;:` before white space, and may run over any number of lines, blank ones among them. No shuffle.
    """

    @F.pandas_udf(f"sentence_ids array<string>, found {FOUND}")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = [scan_text(t) for t in texts]
        return pd.DataFrame({"sentence_ids": [r[0] for r in rows], "found": [[{"license": n, "start": a, "stop": b} for n, a, b in r[1]] for r in rows]})

    return pick(docs, doc_id="long", text="string").select("doc_id", scanned("text").alias("s")).select("doc_id", "s.sentence_ids", "s.found")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, licenses (distinct, in order of name), n_licenses, sentence_ids joined, spans as start-stop joined."""
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    spans = F.array_join(F.transform("found", lambda f: F.concat_ws("-", f["start"].cast("string"), f["stop"].cast("string"))), " ")
    return scanned.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size("found").cast("long").alias("n_licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"), spans.alias("spans"))
