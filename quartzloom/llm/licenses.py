"""License scans: shared grams are chained over a document, and an alignment measures each chain's whole range.

Templates are word sequences, and an inverted index has their grams of ``GRAM`` words (of fewer, where so
short a template could lose all of them at ``COVERAGE``; of templates over ``LONG`` words only winnowed ones).
A template's grams found in a document are chained in order, over inserted text of at most as many words as
the template has, so that a page header or a dropped line does not split a notice. First such chains are
taken that lose little to insertions, so that finds in a row stay apart; what they leave is chained once
more. The range of a chain is aligned with the whole template: matched words are counted, and coverage is
their share of the template. Reported are spans of at least ``COVERAGE`` in which the template's naming
words (``NAMING``) match and no word of ``BARRED`` stands. A notice within a longer one is reported as well.

A span is sure to have a chain if its matched words are in no more pieces than one more than the words that
may be missing: other texts of enough coverage are found if any piece is as long as a gram.

The scan is one pass without a shuffle; a document needs memory for its own words only.

Defined cases: null and empty texts hold no license; templates of a word or two are found as such;
texts of any length are scanned whole; of finds at one place the one that covers more comes first,
then by name; repeated rows give repeated rows; ids may be null and of any type; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.llm.common import LOWER, by_rows, id_ddl, map_arrow, record

WORD = re.compile(r"[^\W_]+")
GRAM, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.8
#: Words from which a template is winnowed, and costs of an inserted or missing word when chaining.
LONG, COSTS = 400, (0.5, 0.01)

#: Notices of public licenses.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-line": "Released under the BSD License.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "BSL-1.0-full": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
#: What follows a notice in the license's whole text, by what it is added to.
_MIT_REST = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_REST = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GPL_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_ZLIB_REST = "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE_REST = "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
TEMPLATES |= {
    "MIT-full": f"{TEMPLATES['MIT']} {_MIT_REST}",
    "BSD-2-Clause-full": f"{TEMPLATES['BSD-2-Clause']} {_BSD_REST}",
    "BSD-3-Clause-full": f"{TEMPLATES['BSD-3-Clause']} {_BSD_REST}",
    "ISC-full": f"{TEMPLATES['ISC']} {_ISC_REST}",
    "0BSD-full": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_REST}",
    "Zlib-full": f"{TEMPLATES['Zlib']} {_ZLIB_REST}",
    "Unlicense-full": f"{TEMPLATES['Unlicense']} {_UNLICENSE_REST}",
    "GPL-3.0-notice-full": f"{TEMPLATES['GPL-3.0-notice']} {_GPL_REST}",
    "GPL-2.0-notice-full": f"{TEMPLATES['GPL-2.0-notice']} {_GPL_REST}",
}

#: Words of a template that must match, each where it stands first, and words that name another license.
NAMING = {
    "Apache-2.0-line": "apache 2",
    "MIT-line": "mit",
    "GPL-3.0-line": "general 3",
    "CC-BY-NC-4.0-line": "by nc 4",
    "GPL-2.0-line": "general 2",
    "LGPL-3.0-line": "lesser general 3",
    "AGPL-3.0-line": "affero general 3",
    "BSD-line": "bsd",
    "MPL-2.0-line": "mozilla 2",
    "CC-BY-4.0-line": "by 4",
    "CC-BY-SA-4.0-line": "by sa 4",
    "CC-BY-ND-4.0-line": "by nd 4",
    "Apache-2.0-notice": "apache 2",
    "GPL-3.0-notice": "general 3",
    "MPL-2.0-notice": "mozilla 2",
    "BSD-3-Clause": "neither",
    "GPL-2.0-notice": "general 2",
    "LGPL-3.0-notice": "lesser general 3",
    "AGPL-3.0-notice": "affero general 3",
    "BSL-1.0-line": "boost 1",
    "LGPL-2.1-notice": "library lesser general 2",
    "EPL-2.0-notice": "eclipse 2",
    "BSD-3-Clause-full": "neither",
    "ISC-full": "notice",
    "GPL-3.0-notice-full": "general 3",
    "GPL-2.0-notice-full": "general 2",
}
BARRED = {n: {"lesser", "library", "affero"} - set(NAMING[n].split()) for n in NAMING if "GPL" in n} | {n: {"nc", "sa", "nd"} - set(NAMING[n].split()) for n in NAMING if n.startswith("CC-BY")}
#: Grants that differ from another license's by a condition or by what they cover.
BARRED |= {"0BSD-full": {"notice"}, "ISC": {"documentation"}, "ISC-full": {"documentation"}}


def tokens(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def winnow(words: list[str]) -> dict[int, tuple[str, ...]]:
    """Place to gram: the least of every WINDOW grams, the rightmost of equals."""
    grams = [tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))]
    rank = [(xxhash.xxh64_intdigest(" ".join(g)), -i) for i, g in enumerate(grams)]
    kept = {-min(rank[i : i + WINDOW])[1] for i in range(max(1, len(rank) - WINDOW + 1))}
    return {i: grams[i] for i in sorted(kept)}


def band_of(template: list[str]) -> int:
    """Words beyond the ends of a chain that are aligned at first: fewer for short templates, so that finds in a row stay apart."""
    return min(BAND, max(1, len(template) // 4))


def grams_of(words: list[str], coverage: float) -> dict[int, tuple[str, ...]]:
    """Place to gram. Grams are so short that one is left when as many words as may be missing break the rest in pieces."""
    if len(words) > LONG:
        return winnow(words)
    missing = int(len(words) * (1 - coverage) + 1e-9)
    size = max(1, min(GRAM, -(-(len(words) - missing) // (missing + 1))))
    return {i: tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def chains(anchors: list[tuple[int, int]], size: int, most: int, cost: float) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """First and last anchor (place in the document, place in the template) of each chain, by most words less the cost of shifts. Anchors are sorted."""
    score, back = [], []
    for a, (at, i) in enumerate(anchors):
        top, come = float(size), -1
        for b in range(a - 1, -1, -1):
            at2, i2 = anchors[b]
            if at - at2 > 2 * most:
                break
            shift = (at - at2) - (i - i2)
            if at2 < at and i2 < i and shift <= most:
                s = score[b] + min(size, at - at2, i - i2) - cost * abs(shift)
                if s > top:
                    top, come = s, b
        score.append(top)
        back.append(come)
    used, out = set(), []
    for last in sorted(range(len(anchors)), key=lambda a: (-score[a], a)):
        if last in used:
            continue
        first = last
        used.add(first)
        while (b := back[first]) >= 0 and b not in used:
            first = b
            used.add(first)
        out.append((anchors[first], anchors[last]))
    return out


class Index:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE):
        self.words = {name: tokens(t) for name, t in templates.items()}
        own = {name for name, t in templates.items() if TEMPLATES.get(name) == t}
        self.naming = {name: frozenset(NAMING.get(name, "").split()) if name in own else frozenset() for name in templates}
        self.needed = {name: frozenset(self.words[name].index(w) for w in self.naming[name]) for name in templates}
        self.barred = {name: BARRED.get(name, set()) if name in own else set() for name in templates}
        self.size: dict[str, int] = {}
        self.places: dict[int, dict[tuple[str, ...], list[tuple[str, int]]]] = {}
        for name, words in self.words.items():
            for i, gram in grams_of(words, coverage).items():
                self.size[name] = len(gram)
                self.places.setdefault(len(gram), defaultdict(list))[gram].append((name, i))
        self.grams = {n: frozenset(p) for n, p in self.places.items()}

    def anchors(self, words: list[str]) -> dict[str, list[tuple[int, int]]]:
        """By template whose naming words are in the document: places (document, template) of shared grams, sorted."""
        held = set(words)
        named = {name for name in self.size if self.naming[name] <= held}
        out = defaultdict(list)
        for n, places in self.places.items():
            if not any(self.size[name] == n for name in named) or self.grams[n].isdisjoint(zip(*(words[k:] for k in range(n)), strict=False)):
                continue
            for at, gram in enumerate(zip(*(words[k:] for k in range(n)), strict=False)):
                for name, i in places.get(gram, ()):
                    if name in named:
                        out[name].append((at, i))
        return out


def align(template: list[str], words: list[str], start: int, band: int = BAND, needed: frozenset[int] = frozenset()) -> tuple[int, int, int]:
    """Most matched words of the template in order within the band round a diagonal, and the first and last (exclusive) word matched.

    A word at a needed place counts len(template) + 1 more, so that these match before others.
    """
    more = len(template) + 1
    best: dict[int, tuple[int, int, int]] = {}  # by place in the document: matches, first, -last, as far as the row has come
    top = (0, 0, 0)
    for i, want in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        left = (0, 0, 0)
        for j in range(max(0, start + i - band), min(len(words), start + i + band + 1)):
            cell = max(left, best.get(j, (0, 0, 0)))
            if words[j] == want:
                n, first, _ = best.get(j - 1, (0, 0, 0))
                cell = max(cell, (n + 1 + more * (i in needed), first if n else j, -(j + 1)))
            row[j] = left = cell
        edge = start + i + band
        if edge + 1 not in row and edge in row:
            row[edge + 1] = row[edge]  # the next row's band reaches one place further
        best = row
        top = max(top, left)
    return top[0], top[1], -top[2]


def spans_of(name: str, anchors: list[tuple[int, int]], words: list[str], index: Index, coverage: float) -> list[tuple[int, int, float]]:
    """(first word, end, share) of one template, without overlaps."""
    template, needed, found = index.words[name], index.needed[name], []
    count, size = Counter(template), len(template)
    for cost in COSTS:
        anchors = [a for a in anchors if not any(f <= a[0] < e for f, e, _ in found)]
        for (at, i), (at2, i2) in chains(anchors, index.size[name], size, cost):
            if any(f < at2 + index.size[name] and at < e for f, e, _ in found):
                continue
            least, most = max((e for _, e, _ in found if e <= at), default=0), min((f for f, _, _ in found if f > at2), default=len(words))
            for slack in (band_of(template), size):
                low, high = max(least, at - i - slack), min(most, at2 + size - i2 + slack)
                part = words[low:high]
                if sum((count & Counter(part)).values()) < coverage * size - 1e-9:
                    continue
                n, first, end = align(template, part, 0, len(part) + size, needed)
                named, n = divmod(n, size + 1)
                if named == len(needed) and n / size >= coverage and index.barred[name].isdisjoint(part[first:end]):
                    found.append((low + first, low + end, n / size))
                    break
    return found


def scan_text(text: str | None, index: Index, coverage: float = COVERAGE) -> list[tuple[str, int, int, float]]:
    """(license, first code point, end, share of the template that matched), by start; overlapping finds of a template count once."""
    words = tokens(text or "")
    found = [(name, *s) for name, anchors in index.anchors(words).items() for s in spans_of(name, anchors, words, index, coverage)]
    if not found:
        return []
    spans = [m.span() for m in WORD.finditer((text or "").translate(LOWER))]
    return [(name, spans[first][0], spans[end - 1][1], share) for name, first, end, share in sorted(found, key=lambda x: (x[1], -x[3], x[0]))]


OUT = pa.schema([("n_licenses", pa.int64()), ("licenses", pa.string()), ("best", pa.string()), ("best_coverage", pa.float64())])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_licenses, licenses as name:start:end:per cent by start, best, best_coverage): a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, coverage)
        for part in by_rows(batches):
            rows = []
            for text in part.column(1).to_pylist():
                found = scan_text(text, index, coverage)
                best = max(found, key=lambda x: (x[3], x[2] - x[1], x[0]), default=(None, 0, 0, 0.0))
                rows.append((len(found), ",".join(f"{n}:{a}:{b}:{round(100 * s)}" for n, a, b, s in found), best[0], best[3]))
            rest = record(OUT, *(zip(*rows, strict=True) if rows else [[]] * 4))
            yield pa.RecordBatch.from_arrays([part.column(0), *rest.columns], names=["doc_id", *OUT.names])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"{id_ddl(docs)}, n_licenses long, licenses string, best string, best_coverage double")


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
