"""License scans (operator 6): sentences are mapped to identifiers, and sequences of identifiers are matched to rules.

A text is cut into segments at line ends and sentence ends; a segment is normalised to words (comment marks, punctuation,
case and spelling go). From the start of each segment a trie of the known sentences is walked, over line ends but not out of
the sentence; the longest known sentence that ends with a segment gives its identifier. The identifiers of a text, in order,
are then matched against the rules, the longest first. Unknown sentences may stand between two identifiers of a rule as
long as they are at most GAP.

Every known sentence has a word that holds one of TRIGGERS, and words are never broken, so a text without any trigger is left
out without loss. An SPDX line gives the licenses that its expression names.

Defined results: null and empty texts have no sentences and no license; overlapping notices are found once, from the left;
repeated rows get equal results; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import table, text_of

#: Parts of words that known sentences hold; each sentence has one at least.
TRIGGERS = ("licen", "copyright", "warrant", "redistribut", "permission", "reserved", "spdx", "domain", "contributors", "damages", "anyone")

#: Known sentences by identifier, as published in the licenses; * stands for one or more words: up to the line's
#: end where it is the last, and over at most two line ends where a name stands in the middle of a sentence.
SENTENCES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License", "This software is released under the MIT License", "Use of this source code is governed by an MIT-style license"],
    "apache2-notice": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Distributed under the Apache License, Version 2.0"],
    "apache2-comply": ["you may not use this file except in compliance with the License", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at *"],
    "apache2-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "Licensed under the GPLv3", "Licensed under the GNU GPL, version 3"],
    "gpl2-notice": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Licensed under the GPLv2"],
    "gpl3-terms": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-terms": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program"],
    "lgpl3-notice": ["Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"],
    "agpl3-notice": ["Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"],
    "mpl2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "cc-by-nc-4-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-4-notice": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4-notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nd-4-notice": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0"],
    "cc0-notice": ["Licensed under CC0 1.0", "This work is dedicated to the public domain"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-include": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-notice": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "all-rights": ["All rights reserved"],
    "copyright": ["Copyright *", "(c) Copyright *"],
    "spdx": ["SPDX-License-Identifier: *"],
}
#: The license of this rule is what the sentence itself names.
NAMED = "*"
#: A license for each ordered sequence of identifiers; ? marks those that may be missing.
RULES = [
    ("MIT", ["mit-grant", "mit-include", "mit-asis", "mit-liable?"]), ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache2-notice?", "apache2-comply", "apache2-copy?", "apache2-asis?", "apache2-see?"]), ("Apache-2.0", ["apache2-notice"]),
    ("GPL-3.0-or-later", ["gpl3-terms", "gpl-hope?", "gpl-details?", "gpl-received?"]), ("GPL-2.0-or-later", ["gpl2-terms", "gpl-hope?", "gpl-details?", "gpl-received?"]),
    ("GPL-3.0-only", ["gpl3-notice"]), ("GPL-2.0-only", ["gpl2-notice"]), ("LGPL-3.0-only", ["lgpl3-notice"]), ("AGPL-3.0-only", ["agpl3-notice"]), ("MPL-2.0", ["mpl2-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]), ("CC-BY-4.0", ["cc-by-4-notice"]), ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]), ("CC-BY-ND-4.0", ["cc-by-nd-4-notice"]), ("CC0-1.0", ["cc0-notice"]),
    ("ISC", ["isc-grant"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]), ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("BSD-style", ["bsd-notice"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone?"]), ("proprietary", ["copyright?", "all-rights"]), (NAMED, ["spdx"]),
]
GAP, LINES = 2, 2

END = re.compile(r"[.!?;:](?=\s|\Z)|\n")
MARKS = re.compile(r"^[\s/*#;%<>!|-]+")
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
EXPRESSION = re.compile(r"[Ii]dentifier\s*:[ \t]*([^\n]*)")
OPERATORS = re.compile(r"[()\s]+(?:AND|OR|and|or)[()\s]+|[()]")


def words(text: str) -> list[str]:
    """Normalised words: lower case, British spelling undone, marks and punctuation gone."""
    return ["license" if w == "licence" else w for w in WORD.findall(text.lower())]


@lru_cache(maxsize=1)
def _trie() -> dict:
    root: dict = {}
    for name, texts in SENTENCES.items():
        for t in texts:
            if not any(x in w for w in words(t) for x in TRIGGERS):
                raise ValueError(f"without a trigger: {t}")
            node = root
            for part in t.split():
                for w in ["*"] if part == "*" else words(part):
                    node = node.setdefault(w, {})
            node[""] = name
    return root


def segments(text: str) -> list[tuple[list[str], bool, int]]:
    """(words, whether the sentence ends here, place in the text) of each segment that has words."""
    out, at = [], 0
    for m in END.finditer(text):
        out.append((words(MARKS.sub("", text[at : m.start()])), m[0] != "\n" or text[m.end() : m.end() + 1] == "\n", at))
        at = m.end()
    out.append((words(MARKS.sub("", text[at:])), True, at))
    return [x for x in out if x[0]]


def _walk(segs: list[tuple[list[str], bool, int]], at: int) -> tuple[str, int] | None:
    """The longest known sentence from segment at on: its name, and the segment after it."""
    best = None
    todo = [(_trie(), at, 0, -1)]  # node, segment, word, the segment in which a * began (-1: none is open)
    seen = set()
    while todo:
        state = todo.pop()
        if (id(state[0]), *state[1:]) in seen:
            continue
        seen.add((id(state[0]), *state[1:]))
        node, s, w, free = state
        if "" in node and (w == 0 and s > at) and (best is None or s > best[1]):
            best = (node[""], s)
        if s >= len(segs):
            continue
        token = segs[s][0][w]
        step = (s, w + 1) if w + 1 < len(segs[s][0]) else (s + 1, 0)
        if token in node:
            todo.append((node[token], *step, -1))
        if "*" in node:
            todo.append((node["*"], *step, s))
        # A * at a sentence's end stays within its line, another within its sentence and a few lines.
        if free >= 0 and (w > 0 or ("" not in node and s - free <= LINES and not segs[s - 1][1])):
            todo.append((node, *step, free))
    return best


def named(text: str) -> list[str]:
    """The licenses of an SPDX line, as written, without AND, OR and brackets."""
    m = EXPRESSION.search(text)
    expression = re.sub(r"\s*(\*/|-->).*", "", m[1]) if m else ""
    return [x for x in (p.strip(" \t\r\"'`;,.") for p in OPERATORS.split(expression)) if x]


def recognise(text: str, filtered: bool = True) -> list[tuple[str, int, int, list[str]]]:
    """(identifier, first segment, segment after the last, licenses it names) of the known sentences of a text, in order."""
    if filtered:
        low = text.lower()
        if not any(t in low for t in TRIGGERS):
            return []
    segs, out, k = segments(text), [], 0
    root = _trie()
    while k < len(segs):
        hit = _walk(segs, k) if segs[k][0][0] in root else None
        if hit:
            line = text[segs[k][2] : segs[hit[1]][2] if hit[1] < len(segs) else len(text)] if hit[0] == "spdx" else ""
            out.append((hit[0], k, hit[1], named(line)))
            k = hit[1]
        else:
            k += 1
    return out


@lru_cache(maxsize=1)
def _rules() -> list[tuple[str, list[tuple[str, bool]]]]:
    return [(name, [(x.rstrip("?"), x.endswith("?")) for x in seq]) for name, seq in sorted(RULES, key=lambda r: -len(r[1]))]


def apply_rules(found: list[tuple[str, int, int, list[str]]]) -> list[str]:
    """The licenses of a sequence of identifiers; each identifier serves one rule."""
    out, k = [], 0
    while k < len(found):
        best = (0, "")
        for name, seq in _rules():
            at, used = k, 0
            for ident, optional in seq:
                near = at < len(found) and (at == k or found[at][1] - found[at - 1][2] <= GAP)
                if near and found[at][0] == ident:
                    at, used = at + 1, used + 1
                elif not optional:
                    used = 0
                    break
            if used > best[0]:
                best = (used, name)
        if best[0]:
            out += found[k][3] if best[1] == NAMED else [best[1]]
        k += max(1, best[0])
    return out


SCANNED = StructType([StructField("n_known", IntegerType()), StructField("sentences", ArrayType(StringType())), StructField("licenses", ArrayType(StringType()))])


@lru_cache(maxsize=1)
def _scan():
    @F.arrow_udf(SCANNED)
    def scan(t: pa.Array) -> pa.Array:
        rows = []
        for text in t.to_pylist():
            found = recognise(text or "")
            rows.append((len(found), [x[0] for x in found], apply_rules(found)))
        n, names, licenses = zip(*rows, strict=True) if rows else ([], [], [])
        text = pa.list_(pa.string())
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(names, text), pa.array(licenses, text)], names=["n_known", "sentences", "licenses"])

    return scan


def scan(text: Column) -> Column:
    """n_known, sentences (identifiers in order) and licenses (in order, with repetitions) of the whole text."""
    return _scan()(text)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", scan(text_of()).alias("s"))
    return docs.select("doc_id", F.col("s.n_known").cast("long").alias("n_known"), F.array_join("s.sentences", ",").alias("sentences"), F.array_join(F.array_sort(F.array_distinct("s.licenses")), ",").alias("licenses"))
