"""Licence scans by sentence rules.

A text is cut into pieces at line ends and after sentence marks. Runs of pieces whose normalised words are a known
licence sentence become that sentence's identifier; licence texts may be wrapped over lines, so a sentence may span
pieces. The identifiers of a text, in order, are then matched against ordered licence rules: at each place the first rule
whose identifiers follow there names the licence. Identifiers that no rule takes are reported as unknown.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .shared import documents, map_columns

# Licence sentences by identifier, and rules in the order in which they are tried.
SENTENCES = {
    "by-apache-2": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "This project is licensed under the Apache License 2.0."],
    "apache-may-not": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-url": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "by-mit": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License", "The MIT License (MIT)"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "mit-liable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "by-bsd-3": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License"],
    "by-bsd-2": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause License"],
    "by-gpl-3": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "Licensed under the GPLv3."],
    "by-gpl-2": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.", "Licensed under the GPLv2."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "by-lgpl-3": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "by-agpl-3": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "by-mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "by-cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "by-cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "by-cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "by-cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "by-cc0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "rights": ["All rights reserved."],
}
RULES = [
    ("Apache-2.0", ["apache-may-not", "apache-comply", "apache-copy", "apache-url", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-may-not", "apache-comply"]),
    ("MIT", ["by-mit", "mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("MIT", ["by-mit", "rights", "mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["by-apache-2"]),
    ("MIT", ["by-mit"]),
    ("BSD-3-Clause", ["by-bsd-3"]),
    ("BSD-2-Clause", ["by-bsd-2"]),
    ("GPL-3.0", ["by-gpl-3"]),
    ("GPL-2.0", ["by-gpl-2"]),
    ("LGPL-3.0", ["by-lgpl-3"]),
    ("AGPL-3.0", ["by-agpl-3"]),
    ("MPL-2.0", ["by-mpl-2"]),
    ("CC-BY-4.0", ["by-cc-by"]),
    ("CC-BY-SA-4.0", ["by-cc-by-sa"]),
    ("CC-BY-NC-4.0", ["by-cc-by-nc"]),
    ("CC-BY-ND-4.0", ["by-cc-by-nd"]),
    ("CC0-1.0", ["by-cc0"]),
    ("Unlicense", ["unlicense"]),
    ("All-rights-reserved", ["rights"]),
]
#: Each sentence holds one of these inside a word, so a text without any of them, however it is wrapped, needs no further look.
ANCHORS = ("licens", "permission", "copyright", "warrant", "redistribut", "reserved", "unencumbered", "merchantab")

_CUT = re.compile(r"\n|(?<=[.;:!?])\s+")
_WORD = re.compile(r"[^\W_]+")


def normalise(s: str) -> str:
    return " ".join(_WORD.findall(s.lower()))


class Scanner:
    def __init__(self, sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> None:
        self.of = {normalise(s): name for name, many in sentences.items() for s in many}
        self.sorted = sorted(self.of)
        self.rules = [(name, tuple(ids)) for name, ids in rules]
        weak = [s for s in self.of if not any(a in s for a in ANCHORS)]
        if weak:
            raise ValueError(f"no anchor in {weak}")

    def sentences(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of known sentences, the longest at each place, left to right."""
        cuts, pieces, at = [m.span() for m in _CUT.finditer(text)], [], 0
        for a, b in [*cuts, (len(text), len(text))]:
            if a > at and (words := normalise(text[at:a])):
                pieces.append((words, at, a))
            at = b
        out, k = [], 0
        while k < len(pieces):
            so_far, best = "", None
            for j in range(k, len(pieces)):
                so_far = f"{so_far} {pieces[j][0]}" if so_far else pieces[j][0]
                if so_far in self.of:
                    best = (self.of[so_far], pieces[k][1], pieces[j][2], j)
                i = bisect_left(self.sorted, so_far)
                i += i < len(self.sorted) and self.sorted[i] == so_far
                if i == len(self.sorted) or not self.sorted[i].startswith(so_far + " "):
                    break
            if best:
                out.append(best[:3])
                k = best[3] + 1
            else:
                k += 1
        return out

    def licences(self, ids: list[str]) -> tuple[list[tuple[str, int, int]], list[str]]:
        """(licence, first, last) over the identifiers, and the identifiers that no rule takes."""
        found, rest, k = [], [], 0
        while k < len(ids):
            for name, rule in self.rules:
                if tuple(ids[k : k + len(rule)]) == rule:
                    found.append((name, k, k + len(rule) - 1))
                    k += len(rule)
                    break
            else:
                rest.append(ids[k])
                k += 1
        return found, rest

    def scan(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[str], int]:
        """(licence, start, end) in the text, unknown identifiers, number of known sentences."""
        if not text:
            return [], [], 0
        low = text.lower()
        if not any(a in low for a in ANCHORS):
            return [], [], 0
        known = self.sentences(text)
        found, rest = self.licences([x[0] for x in known])
        return [(name, known[a][1], known[b][2]) for name, a, b in found], rest, len(known)


def scan_licences(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds licences (distinct, sorted, joined by commas), n_licences (matches), licence_spans (licence:start-end, joined by
    semicolons, in characters), n_sentences and unknown (identifiers no rule takes, joined by commas).

    A null or empty text has none of them; of rules that fit at one place the first counts; texts are read whole. Columns of
    these names in the input are replaced; others pass through, or only those named by keep. No rows give no rows.
    """
    made = StructType().add("licences", "string").add("n_licences", "long").add("licence_spans", "string").add("n_sentences", "long").add("unknown", "string")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made.names]

    def work():
        scanner = Scanner()

        def run(texts: list[str | None]) -> list:
            got = [scanner.scan(t) for t in texts]
            return [
                [",".join(sorted({x[0] for x in m[0]})) for m in got],
                [len(m[0]) for m in got],
                [";".join(f"{x[0]}:{x[1]}-{x[2]}" for x in m[0]) for m in got],
                [m[2] for m in got],
                [",".join(m[1]) for m in got],
            ]

        return run

    return map_columns(docs, [text_col], keep, made, work)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, licences, n_licences, licence_spans, n_sentences, unknown."""
    return scan_licences(documents(spark, sf_dir), keep=["doc_id"])
