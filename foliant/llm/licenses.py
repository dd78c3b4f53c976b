"""Licence texts in documents, by patience alignment against templates.

Words that occur once in the document's stretch and once in the template anchor an alignment; the
longest increasing subsequence of the anchors is kept, and the gaps between them are aligned in the
same way, where equal words at a gap's ends are matched too. Coverage is the matched share of the
template's words. A template is tried around each place of its word that is rarest in the document, so
that notices that stand in a document several times are found each time; it isn't tried where the
words it shares with the document, counted with repetition, can't reach the coverage asked for.

Nulls: a null text counts as empty. Repeated rows give equal rows. Texts are read whole. Other columns
are not read; an empty table gives no rows."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm._shared import map_batches, texts_of

WORD = re.compile(r"[a-z0-9]+(?:[.\-'][a-z0-9]+)*")

# Wording of public licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
}


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(lower-cased word, start, end)."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals have longer lower cases: offsets must be the text's
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that increases in both members; pairs are sorted by the first."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            ends.append(k)
        else:
            tops[at], ends[at] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b) of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        where = {w: y for y, w in enumerate(b[k:m], k) if in_b[w] == 1 and in_a[w] == 1}
        anchors = increasing([(x, where[w]) for x, w in enumerate(a[i:j], i) if w in where])
        last = (i, k)
        for x, y in anchors:
            out.append((x, y))
            work.append((last[0], x, last[1], y))
            last = (x + 1, y + 1)
        if anchors:
            work.append((last[0], j, last[1], m))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {k: [w for w, _, _ in words_of(t)] for k, t in templates.items()}
        self.counts = {k: Counter(t) for k, t in self.templates.items()}
        self.vocabulary = {w for t in self.templates.values() for w in t}

    def scan(self, text: str) -> list[dict]:
        low = text.lower()
        known = Counter(w for w in WORD.findall(low) if w in self.vocabulary)
        likely = [k for k, c in self.counts.items() if sum(min(n, known[w]) for w, n in c.items() if w in known) >= self.coverage * len(self.templates[k])]
        if not likely:
            return []
        words = words_of(text)
        plain = [w for w, _, _ in words]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(plain):
            if w in self.vocabulary:
                places.setdefault(w, []).append(i)
        hits = []
        for name in likely:
            t = self.templates[name]
            slack = max(2, len(t) // 5)
            # the rarest of the words of which at least one must be there if the coverage is to be reached
            allowed = len(t) - int(-(-self.coverage * len(t) // 1))
            by_rarity = sorted(set(t), key=lambda w: (len(places.get(w, ())), w))
            missed, probes = 0, []
            for w in by_rarity:
                if places.get(w):
                    probes.append(w)
                missed += self.counts[name][w]
                if missed > allowed:
                    break
            done_to = -1
            for i in sorted({i for w in probes for i in places[w]}):
                if i <= done_to:
                    continue
                offsets = [y for y, w in enumerate(t) if w == plain[i]]
                lo, hi = max(done_to + 1, i - offsets[-1] - slack), min(len(plain), i + len(t) - offsets[0] + slack)
                got = align(plain[lo:hi], t)
                if got and len(got) >= self.coverage * len(t):
                    a, b = lo + got[0][0], lo + got[-1][0]
                    hits.append({"license": name, "coverage": len(got) / len(t), "start": words[a][1], "end": words[b][2]})
                    done_to = b
        return hits


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage, start, end) of each place where a template is covered."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = Scanner(templates, coverage)
        rows, hits = [], []
        for r, text in enumerate(texts_of(batch.column(1))):
            for h in scanner.scan(text):
                rows.append(r)
                hits.append(h)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([h["license"] for h in hits], pa.string()), pa.array([h["coverage"] for h in hits], pa.float64()), pa.array([h["start"] for h in hits], pa.int32()), pa.array([h["end"] for h in hits], pa.int32())], [id_col, "license", "coverage", "start", "end"])

    source = docs.select(id_col, text_col)
    return map_batches(source, kernel, f"{id_col} {source.schema[0].dataType.simpleString()}, license string, coverage double, start int, end int")
