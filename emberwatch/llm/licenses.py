"""License scans: where documents carry a license notice, how much of it, and from where to where.

Templates are winnowed: of every few consecutive word n-grams the one of smallest hash is a fingerprint,
and an inverted index leads from fingerprints to templates and places in them. Of short templates all
pairs of neighbouring words are fingerprints, as an edit may hit the few that winnowing leaves. A document
looks up all its n-grams, so a notice of any length is met if one fingerprint of it is intact. Hits of a
template on like diagonals are one candidate, which is aligned with the template within a band around
them: the longest common subsequence of words there gives coverage and span. License tags (SPDX) are exact
names and are read as they stand, with coverage 1.

The templates are a fixed, small set and go to all tasks; documents are not shuffled. Null or empty text
has no hits. A document has a row per place where it carries a notice; places of one template that
overlap are one row, the best one, ties to the earliest; so are places of like templates (LGPL, GPL) that
cover nearly the same words. Repeated rows are scanned each for itself.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import NO_ID
from emberwatch.llm.decontaminate import tokens

GRAM, WINNOW, BAND, COVERAGE = 3, 4, 8, 0.8
#: Templates of fewer words have all their pairs of words in the index.
SHORT = 24
#: Places of two templates are the same if they share so much of the longer one.
SAME = 0.75
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9][\w.+-]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9][\w.+-]*\)?)*)")
_TOKEN = re.compile(r"\w+")
_ODD = 0x9E3779B97F4A7C15

#: The wording of public license notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
        file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms
        of the GNU General Public License as published by the Free Software Foundation, either version 3 of
        the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies.""",
    "MIT notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
        copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms
        of the GNU Affero General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "BSD conditions": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution.""",
    "BSD notice": "Released under the BSD License.",
    "BSD-3-Clause endorsement": """Neither the name of the copyright holder nor the names of its contributors may
        be used to endorse or promote products derived from this software without specific prior written
        permission.""",
    "CC-BY-4.0 short notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0
        International License.""",
    "CC-BY-SA-4.0 short notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": """To the extent possible under law, the author has waived all copyright and related or
        neighboring rights to this work.""",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms
        of the GNU General Public License as published by the Free Software Foundation; either version 2 of
        the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms
        of the GNU Lesser General Public License as published by the Free Software Foundation; either version
        2.1 of the License, or (at your option) any later version. This library is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms
        of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "MIT warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


class Grams:
    """The n-grams of a block of items: numbers of their words, and each gram's place in `keys`."""

    def __init__(self, items: list[str], gram: int):
        self.gram = gram
        split = [tokens(t) for t in items]
        self.longest = max(map(len, split), default=0)
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for t in split for w in t}))}
        of = [self.keys_of(self.numbers(t)) for t in split]
        self.keys = np.unique(np.concatenate(of)) if of else np.empty(0, "u8")
        self.of_item = [np.searchsorted(self.keys, k) for k in of]

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], "u8")

    def keys_of(self, numbers: np.ndarray) -> np.ndarray:
        n = max(0, len(numbers) - self.gram + 1)
        key = np.zeros(n, "u8")
        for k in range(self.gram):
            key = (key + numbers[k : k + n]) * np.uint64(_ODD)
            key ^= key >> np.uint64(29)
        return key

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a gram of some item begins, and which."""
        n = len(numbers) - self.gram + 1
        if n < 1 or not len(self.keys):
            return np.empty(0, "i8"), np.empty(0, "i8")
        whole = numbers[:n] > 0
        for k in range(1, self.gram):
            whole &= numbers[k : k + n] > 0
        at = np.flatnonzero(whole)
        if not len(at):
            return at, at
        key = np.zeros(len(at), "u8")
        for k in range(self.gram):
            key = (key + numbers[at + k]) * np.uint64(_ODD)
            key ^= key >> np.uint64(29)
        near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[near] == key
        return at[hit], near[hit]


def winnow(keys: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the smallest key of every `window` consecutive ones; all of a shorter row are one."""
    if len(keys) <= window:
        return np.array([int(keys.argmin())] if len(keys) else [], "i8")
    views = np.lib.stride_tricks.sliding_window_view(keys, window)
    return np.unique(views.argmin(1) + np.arange(len(views)))


class Index:
    """Inverted index from a gram's number to the templates, and places in them, that it marks."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [tokens(templates[n]) for n in self.names]
        short = [len(words) < SHORT for words in self.words]
        self.tables = []
        for gram, mine in ((GRAM, [not s for s in short]), (2, short)):
            grams = Grams([templates[n] if m else "" for n, m in zip(self.names, mine, strict=True)], gram)
            marks: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for k, of in enumerate(grams.of_item):
                for place in range(len(of)) if short[k] else winnow(grams.keys[of]):
                    marks[int(of[place])].append((k, int(place)))
            self.tables.append((grams, marks))

    def candidates(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(template, least and greatest diagonal) of hits that lie within one band."""
        hits = defaultdict(list)
        for grams, marks in self.tables:
            at, which = grams.places(grams.numbers(words))
            for place, gram in zip(at.tolist(), which.tolist(), strict=True):
                for k, inside in marks.get(gram, ()):
                    hits[k].append(place - inside)
        found = []
        for k, diagonals in hits.items():
            diagonals.sort()
            begin = last = diagonals[0]
            for diagonal in [*diagonals[1:], None]:
                if diagonal is None or diagonal - begin > band(self.words[k]):
                    found.append((k, begin, last))
                    begin = diagonal
                last = diagonal
        return found


def band(template: list[str]) -> int:
    """Narrower for short templates, or two copies in a row would be one."""
    return min(BAND, len(template) // 4)


def align(template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int]:
    """Words in common, in order, where a word's place differs from its place in the template by a
    diagonal from low - band to high + band; the first and the past-the-last word of the document."""
    none, wide = (0, 0, 0), band(template)
    row: dict[int, tuple[int, int, int]] = {}
    for i, wanted in enumerate(template):
        here, left = {}, none
        for j in range(max(0, i + low - wide), min(len(words), i + high + wide + 1)):
            best = max(left, row.get(j, none), key=lambda s: (s[0], s[1] - s[2]))
            if words[j] == wanted:
                count, first, _ = row.get(j - 1, none)
                met = (count + 1, first if count else j, j + 1)
                best = max(best, met, key=lambda s: (s[0], s[1] - s[2]))
            here[j] = left = best
        row = here
    return max(row.values(), key=lambda s: (s[0], s[1] - s[2]), default=none)


def find(index: Index, text: str | None, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first and past-the-last character) of every notice in a text."""
    words = tokens(text)
    found = []
    for k, low, high in index.candidates(words):
        count, a, b = align(index.words[k], words, low, high)
        if count >= coverage * len(index.words[k]):
            found.append((k, count, a, b))
    tags = [(f"SPDX {' '.join(m[1].split())}", 1.0, *m.span()) for m in _SPDX.finditer(text or "")]
    if not found:
        return tags
    chosen: list[tuple[int, int, int, int]] = []
    for k, count, a, b in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
        if all(k != other or b <= c or a >= d for other, _, c, d in chosen):
            chosen.append((k, count, a, b))
    best = [one for one in chosen if not any(_better(index, other, one) for other in chosen)]
    # Lower-casing may change a text's length, so places are those of the words as they stand.
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(spans) != len(words):
        spans = [m.span() for m in _TOKEN.finditer(text.lower())]
    return sorted(
        [*tags, *((index.names[k], n / len(index.words[k]), spans[a][0], spans[b - 1][1]) for k, n, a, b in best)]
    )


def _better(index: Index, one: tuple, other: tuple) -> bool:
    """Whether one place is nearly that of the other and its template fits better."""
    (k, n, a, b), (i, m, c, d) = one, other
    same = min(b, d) - max(a, c) >= SAME * max(b - a, d - c)
    return k != i and same and (n / len(index.words[k]), n) > (m / len(index.words[i]), m)


def _scan(shared, coverage: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        for frame in frames:
            rows = [(doc, *hit) for doc, text in zip(frame["doc"], frame["text"], strict=True) for hit in find(index, text, coverage)]
            yield pd.DataFrame(rows, columns=["doc", "license", "coverage", "begin", "end"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per notice found: doc_id, license, coverage, begin and end (characters of the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    kinds = "doc long, license string, coverage double, begin long, end long"
    found = texts.mapInPandas(_scan(shared, coverage), kinds)
    return found.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id")
