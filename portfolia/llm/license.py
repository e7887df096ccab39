"""License scans by patience alignment of template words with the words of a text.

For a template, words that are unique in both the template and a stretch of text are anchors; the longest
increasing subsequence of their places is kept, and the gaps between anchors are aligned in the same way. A gap
without unique words is settled by the longest common subsequence. Coverage is the share of the template's words
that are aligned; a notice counts from ``COVERAGE``.

Every place of a template's telling words says where a notice would start, and the template is aligned with the
stretch of its own length there. Telling words are so many of the longest ones that a notice of the wanted coverage
must hold one of them, so no notice is passed over. Of an alignment the densest run counts, and strange words within
it count against it: at least ``COVERAGE`` of the words from its first to its last must be aligned. When the best
notices are taken, what is left between them is aligned again until it holds no more.

Rows: every row of the input gives one row per notice found, or one with a null license and coverage 0. Null text
counts as empty; repeated rows are scanned alike; overlapping notices are settled for the one with most aligned
less missing and strange words, so that an altered BSD-3 text is not taken for the BSD-2 text within it, then for the
higher coverage, then for the earlier name. "All rights reserved." beside a longer notice is part of its copyright line
and gives no row. Other columns are unread.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.85

# Names of licenses and notices that announce them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files, to deal in the Software without restriction, including without "
                "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                "copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "proprietary": "All rights reserved.",
}

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. ")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
          "promote products derived from this software without specific prior written permission. ")
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(kind: str, version: str, only: bool) -> str:
    """The file header of a GNU license; ``only`` without later versions."""
    which = (f"version {version} of the License." if only else
             f"either version {version} of the License, or (at your option) any later version.")
    return ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            f"{kind} Public License as published by the Free Software Foundation, {which} This program is distributed "
            "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
            f"{kind} Public License for more details.")


# Whole texts and file headers of common licenses.
TEMPLATES |= {
    "MIT-full": TEMPLATES["MIT-text"].replace("files, to", "files (the \"Software\"), to").replace(
        "so.", "so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. ") +
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
           "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
           "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
           "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
           "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
           "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-header":
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
               "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
               "to this work.",
    "GPL-2.0-only": _gnu("General", "2", True), "GPL-2.0-or-later": _gnu("General", "2", False),
    "GPL-3.0-only": _gnu("General", "3", True), "GPL-3.0-or-later": _gnu("General", "3", False),
    "LGPL-2.1-or-later": _gnu("Lesser General", "2.1", False), "LGPL-3.0-or-later": _gnu("Lesser General", "3", False),
    "AGPL-3.0-or-later": _gnu("Affero General", "3", False),
}
#: A notice of so many words or more settles the license of "All rights reserved." up to NEAR words before or behind.
LONG, NEAR = 20, 16

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> tuple[list[str], list[int]]:
    """Lower-cased words and their character places."""
    found = [(m[0], m.start()) for m in _WORD.finditer(text.lower())]
    return [w for w, _ in found], [p for _, p in found]


def _increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (a, b), ordered by a, in which b increases (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(places)
    for i, (_, b) in enumerate(places):
        at = bisect_left(tops, b)
        back[i] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b), piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(places[i])
        i = back[i]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The longest common subsequence, as places."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, increasing in both."""
    if not a or not b:
        return []
    in_a, in_b = Counter(a), Counter(b)
    at_b = {w: j for j, w in enumerate(b)}
    anchors = _increasing([(i, at_b[w]) for i, w in enumerate(a) if in_a[w] == 1 and in_b.get(w) == 1])
    if not anchors:
        return _common(a, b) if in_a.keys() & in_b.keys() else []
    out, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        out += [(i + p, j + q) for p, q in patience(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


@lru_cache(maxsize=256)
def _prepared(template: str, coverage: float) -> tuple[list[str], frozenset[str], int]:
    """Words, telling words, and how many words must be aligned."""
    words, _ = words_of(template)
    needed = next(k for k in range(1, len(words) + 2) if k >= coverage * len(words))
    spare = len(words) - needed  # so many words may be missing
    order = sorted(range(len(words)), key=lambda i: (-len(words[i]), i))
    return words, frozenset(words[i] for i in order[: spare + 1]), needed


def _enough(bag: Counter, have: Counter, needed: int) -> bool:
    """Whether so many words of a template can be aligned at all, whatever their order."""
    return sum(min(n, have[w]) for w, n in bag.items()) >= needed


class Notice(NamedTuple):
    """An aligned notice: words ``first`` to ``last``; ``gain`` is matched words less missing and strange ones."""

    gain: int
    share: float
    name: str
    first: int
    last: int
    matched: int


def _densest(places: list[int]) -> tuple[int, int]:
    """The run of aligned places (as a slice) with the most matches less the strange words between them."""
    best, out, total, begin = 0, (0, 0), 0, 0
    for i, p in enumerate(places):
        grown = total + 2 - (p - places[i - 1]) if total > 0 else 0
        if grown > 1:
            total = grown
        else:
            total, begin = 1, i
        if total > best:
            best, out = total, (begin, i + 1)
    return out


def _align(own: list[str], words: list[str], begin: int, end: int) -> tuple[int, int, int]:
    """Matched words of a template in a stretch, and the first and last of them, where they lie densest."""
    places = [begin + j for _, j in patience(own, words[begin:end])]
    i, j = _densest(places)
    return (j - i, places[i], places[j - 1]) if j else (0, 0, 0)


def _candidates(words: list[str], begin: int, end: int, wanted: dict, coverage: float) -> list[Notice]:
    """All notices that align with a stretch of words, overlaps included."""
    out, have = [], Counter(words[begin:end])
    for name, (own, tells, needed) in wanted.items():
        bag, size = Counter(own), len(own)
        if not _enough(bag, have, needed):
            continue
        where: dict[str, list[int]] = {}
        for p, w in enumerate(own):
            if w in tells:
                where.setdefault(w, []).append(p)
        slack = max(2, size - needed + size // 10)
        tried = set()
        # A telling word says where a notice would start; places next to one another are one place.
        for i in range(begin, end):
            for p in where.get(words[i], ()):
                if (key := (i - p) // (slack // 2 + 1)) in tried:
                    continue
                tried.add(key)
                found = (0, 0, 0)
                for room in (slack, 0):
                    a, b = max(begin, i - p - room), min(end, i - p + size + room)
                    if _enough(bag, Counter(words[a:b]), needed):
                        found = max(found, _align(own, words, a, b), key=lambda f: 2 * f[0] - (f[2] - f[1] + 1))
                matched, first, last = found
                span = last - first + 1
                # As many words of the text as of the template must be aligned: strange words count against a notice.
                if matched >= needed and matched >= coverage * span:
                    out.append(Notice(3 * matched - size - span, matched / size, name, first, last, matched))
    return out


def scan(text: str, templates: dict[str, str], coverage: float = COVERAGE) -> list[tuple]:
    """Notices of a text: (license, start, end, matched words, coverage); places are characters.

    The best notices are taken first; what is left between them is aligned again until it holds no more.
    """
    low = text.lower()
    prepared = {name: _prepared(template, coverage) for name, template in templates.items()}
    wanted = {name: p for name, p in prepared.items() if any(w in low for w in p[1])}
    if not wanted:
        return []
    words, at = words_of(text)
    taken: list[Notice] = []
    open_ = [(0, len(words))]
    while open_:
        begin, end = open_.pop()
        here: list[Notice] = []
        for n in sorted(_candidates(words, begin, end, wanted, coverage), key=lambda n: (-n.gain, -n.share, n.name, n.first)):
            if all(n.last < x.first or n.first > x.last for x in here):
                here.append(n)
        edges = [begin - 1, *(e for n in sorted(here, key=lambda n: n.first) for e in (n.first, n.last)), end]
        if here:
            open_ += [(a + 1, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a + 1]
        taken += here
    grants = [n for n in taken if n.name != "proprietary" and n.matched >= LONG]
    kept = [n for n in taken if n.name != "proprietary"
            or all(n.last + NEAR < g.first or n.first > g.last + NEAR for g in grants)]
    return [(n.name, at[n.first], at[n.last] + len(words[n.last]), n.matched, n.share)
            for n in sorted(kept, key=lambda n: n.first)]


def scan_texts(df: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice found in a whole text, or one row without a license."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["license", "start", "end", "matched", "coverage"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column(1)):
                for hit in scan(text.as_py() or "", templates, coverage) or [(None, None, None, 0, 0.0)]:
                    row.append(i)
                    found.append(hit)
            columns = [pa.array([h[k] for h in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *columns], names=[id_col, *names])

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, license string, start long, end long, matched long, coverage double")
