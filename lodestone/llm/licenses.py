"""License scans: normalised text against license templates by Dice over word bigrams.

A document's segments are its whole text, its paragraphs (stretches between blank lines), its
lines, and windows: for each template, the runs of words, across lines and paragraphs, that
begin and end with a bigram of it, have at most the words that Dice allows, and are the best
where they lie. A window is left out where a segment of the other kinds or a better window that
matches the same license overlaps it. A segment's words are lower-cased runs of letters and digits, with spelling variants
folded; its bigrams are a set. A template is a candidate for a segment of a bigrams only if
its number b of bigrams lets Dice, 2 * min(a, b) / (a + b), reach the threshold: templates are
kept sorted by size and the candidates are a slice. A segment without any bigram of any
template is passed by. Every match at or above the threshold counts; the best names the
document's license, by Dice, then by the longer template, then by name.

Defined results: a null or empty text, or one without two words in any segment, matches
nothing; license is null and dice 0. Repeated lines match each time; a line that is a whole
paragraph, or a paragraph that is the whole text, is one segment. Any length is read whole.
Rows are judged alone: nothing is shuffled. Extra columns pass, those named like an output are
replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import license_texts as full
from lodestone.llm.common import read, tidied

THRESHOLD = 0.8

#: Spelling variants that count as the same word.
VARIANTS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "http": "https", "v2": "2", "v3": "3"}

_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_BSD_TWO = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.
"""
#: Fixed values: (license, template). A license may have several templates.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software.""" + _WARRANTY),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD_TWO + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TWO + """3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.""" + _BSD_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
    ("Proprietary", "All rights reserved."),
    ("Apache-2.0", full.APACHE_2_0),
    ("GPL-3.0", full.GPL_3_0),
    ("MPL-2.0", full.MPL_2_0),
    ("CC0-1.0", full.CC0_1_0),
)

_WORD = re.compile(r"[^\W_]+")
_BLANK_LINE = re.compile(r"\n[ \t-\r]*\n")


def words(text: str) -> list[str]:
    return [VARIANTS.get(w, w) for w in _WORD.findall(text.lower())]


def bigrams(ws: list[str]) -> set[tuple[str, str]]:
    return set(zip(ws, ws[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        made = sorted(((len(g), name, g) for name, text in templates if (g := bigrams(words(text)))), key=lambda x: x[:2])
        self.sizes, self.templates, self.threshold = [m[0] for m in made], made, threshold
        self.firsts = {a for _, _, g in made for a, _ in g}
        self.known = set().union(*(g for _, _, g in made)) if made else set()
        self.least = threshold / (2 - threshold)
        # for windows: the templates of a bigram, and for each the bigrams it needs at least and the words of a window at most
        self.having: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, (_, _, g) in enumerate(made):
            for pair in g:
                self.having[pair].append(k)
        longest = {(name, frozenset(bigrams(ws))): len(ws) for name, text in templates if (ws := words(text))}
        self.needs = [math.ceil(n * self.least - 1e-9) for n, _, _ in made]
        self.spans = [math.ceil(longest[name, frozenset(g)] / self.least) for _, name, g in made]

    def candidates(self, a: int) -> list[tuple[int, str, set]]:
        """Templates whose size lets a segment of a bigrams reach the threshold."""
        return self.templates[bisect_left(self.sizes, a * self.least - 1e-9) : bisect_right(self.sizes, a / self.least + 1e-9)]

    def matches(self, text: str) -> list[tuple[float, int, str, int, int]]:
        """(Dice, template's size, license, begin, end) of every matching segment."""
        if not self.sizes:
            return []
        found = []
        most = self.sizes[-1] / self.least + 1
        for begin, end in segments(text, self):
            part = text[begin:end]
            # a segment of few bigrams may still have many words, but not fewer than bigrams
            ws = words(part)
            if len(ws) < 2 or self.firsts.isdisjoint(ws):
                continue
            g = bigrams(ws)
            if len(g) > most or not (common := g & self.known):
                continue
            for size, name, t in self.candidates(len(g)):
                score = 2 * len(common & t) / (len(g) + size)
                if score >= self.threshold:
                    found.append((score, size, name, begin, end))
        return found


    def windows(self, text: str, others: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Places of the windows that others, places too, don't cover as well."""
        ws = words(text)
        if self.firsts.isdisjoint(ws):
            return []
        pairs = list(zip(ws, ws[1:], strict=False))
        hits: dict[int, list[int]] = defaultdict(list)
        for i, pair in enumerate(pairs):
            if pair in self.known:
                for k in self.having[pair]:
                    hits[k].append(i)
        found = []
        for k, at in hits.items():
            size, name, t = self.templates[k]
            need, most = self.needs[k], self.spans[k]
            if len(at) < need or len({pairs[i] for i in at}) < need:
                continue
            found += [(score, size, name, i, j) for score, i, j in self._best(pairs, at, t, need, most)]
        if not found:
            return []
        low = text.lower()
        places = [m.span() for m in _WORD.finditer(low)]
        if len(low) != len(text):  # a few letters are longer in lower case
            origin = [i for i, c in enumerate(text) for _ in c.lower()]
            places = [(origin[a], origin[b - 1] + 1) for a, b in places]
        taken: dict[str, list[tuple[int, int]]] = defaultdict(list)
        parts = [(a, b, bigrams(words(text[a:b]))) for a, b in others]
        out = []
        for score, size, name, i, j in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            a, b = places[i][0], places[j + 1][1]
            if any(x < b and a < y for x, y in taken[name]):
                continue
            if any(x < b and a < y and any(n == name and dice(g, t) >= self.threshold for _, n, t in self.candidates(len(g))) for x, y, g in parts):
                continue
            taken[name].append((a, b))
            out.append((a, b))
        return out

    def _best(self, pairs, at: list[int], t: set, need: int, most: int) -> list[tuple[float, int, int]]:
        """(Dice, first, last bigram) of each start's best window; a window begins and ends with stretches of hits, as each hit more raises Dice."""
        out = []
        hit = set(at)
        for n, i in enumerate(at):
            if i - 1 in hit or n + need > len(at) or at[n + need - 1] - i >= most:
                continue
            seen, common, best = set(), 0, None
            end = min(i + most, len(pairs))
            for j in range(i, end):
                if pairs[j] not in seen:
                    seen.add(pairs[j])
                    common += pairs[j] in t
                    if len(seen) * self.least > len(t) + 1e-9:
                        break
                if j in hit and (j + 1 not in hit or j + 1 == end):
                    score = 2 * common / (len(seen) + len(t))
                    if score >= self.threshold and (best is None or score > best[0]):
                        best = (score, i, j)
            if best:
                out.append(best)
        return out


_scanner: list[Scanner] = []


def segments(text: str, scanner: Scanner | None = None) -> list[tuple[int, int]]:
    """Places of the whole text, its paragraphs, its lines and its windows, each once and without blank ends."""
    if scanner is None:
        if not _scanner:
            _scanner.append(Scanner())
        scanner = _scanner[0]
    others = _plain_segments(text)
    return sorted({*others, *scanner.windows(text, others)})


def _plain_segments(text: str) -> list[tuple[int, int]]:
    spans = {(0, len(text))}
    at = 0
    for m in _BLANK_LINE.finditer(text):
        spans.add((at, m.start()))
        at = m.end()
    spans.add((at, len(text)))
    at = 0
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        spans.add((at, stop))
        at = stop + 1
    out = set()
    for a, b in spans:
        s = text[a:b]
        if s and not s.isspace():
            out.add((a + len(s) - len(s.lstrip()), b - len(s) + len(s.rstrip())))
    return sorted(out)


_OUT = {"license": "string", "dice": "double", "n_matches": "bigint", "matches": "string"}


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs without text, with license, dice, n_matches and matches (license:begin:end, by place)."""
    rest = [c for c in docs.columns if c != text and c not in _OUT]
    src = docs.select(*rest, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            got = [scanner.matches(t.as_py() or "") for t in batch.column(len(rest))]
            best = [max(g, key=lambda m: (m[0], m[1], m[2])) if g else None for g in got]
            cols = [
                pa.array([b and b[2] for b in best], pa.string()),
                pa.array([b[0] if b else 0.0 for b in best], pa.float64()),
                pa.array([len(g) for g in got], pa.int64()),
                pa.array([",".join(f"{n}:{a}:{e}" for _, _, n, a, e in sorted(g, key=lambda m: (m[3], m[4], m[2], m[1]))) for g in got], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *cols], names=[*rest, *_OUT])

    return src.mapInArrow(tidied("licenses", run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), *(f"{k} {v}" for k, v in _OUT.items())]))


def op1_licenses(spark, sf_dir) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_licenses": op1_licenses}
