"""License scans by patience alignment.

A place in a text is compared with a license text by anchoring on the words that
stand once in both, taking the longest increasing subsequence of the anchors, and
aligning the gaps between them in the same way. Matched words over the words
of the license text are its coverage.

A text is scanned where words that are special to a license stand: the window
there is aligned, and after a match the scan goes on behind it, so repeated and
several licenses are found each. What such windows don't explain is searched for
fragments, runs of RUN matched words or more with gaps of at most GAP words; fragments
in the order of the license make one place together, whatever stands between
them. At least half of the words that no other license has must match, so texts
that differ in the name alone aren't taken for each other. Of licenses of one family
that match the same words the longest is kept. A license text
none of whose places can reach the coverage, because too few of its words stand
in the document at all, isn't aligned; that bound loses nothing.

Words are lower-case letters and digits; words with digits count as equal, so a
version doesn't matter. Null, empty and wordless texts have no license, and an
empty table no rows. Rows with one doc_id, or with a null one, are scanned each,
and repeated rows give repeated results. Very long texts are scanned whole, in
time that grows with their length. Columns of other names aren't read.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudstrata.llm.bpe import calm_gc, TwoGenerations

COVERAGE = 0.75
#: Matched words of a fragment at least, and words between two of them at most.
RUN, GAP = 8, 6

#: Public license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
        of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Whole license texts, without their titles and copyright lines; public and fixed.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_MIT_LIABILITY = """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
    WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_BEGIN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
    the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
    PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
    LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
    (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NOTICES |= {
    "MIT-full": f"{NOTICES['MIT-text']} {_AS_IS} {_MIT_LIABILITY}",
    "BSD-2-full": f"{_BSD_BEGIN} {_BSD_END}",
    "BSD-3-full": f"""{_BSD_BEGIN} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission. {_BSD_END}""",
    "ISC-full": f"""{NOTICES["ISC"]} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
        OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense-full": f"""{NOTICES["Unlicense"]} Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
        make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
        future rights to this software under copyright law. {_AS_IS} IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
        anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2.
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0-full": f"""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
        reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to
        the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
        Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor. {_AS_IS[:-len("AND NONINFRINGEMENT.")]}, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER
        IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: Words that don't tell a license: a scan doesn't begin at them.
PLAIN = frozenset("the of and to in is it that for on are as with be by at from this an a or any not was will you can no all if do".split())
FIND = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> list[str]:
    """Words of letters and digits; # stands for a word with a digit, and a run of such is one."""
    out: list[str] = []
    for w in FIND(text.lower()):
        w = "#" if any(map(str.isdigit, w)) else w
        if w != "#" or out[-1:] != ["#"]:
            out.append(w)
    return out


def _increasing(values: list[int]) -> list[int]:
    """The places of a longest strictly increasing subsequence, by piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[p], at[p] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of a and b, in order."""
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
        if i == j or k == m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        where = {w: p for p, w in enumerate(b[k:m], k) if cb[w] == 1 and ca.get(w) == 1}
        anchors = [(p, where[w]) for p, w in enumerate(a[i:j], i) if w in where]
        kept = [anchors[p] for p in _increasing([q for _, q in anchors])]
        if kept:
            out += kept
            ends = [(i - 1, k - 1), *kept, (j, m)]
            work += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Scanner:
    """Scans texts for license texts. A text is an array of numbers of the words that the license texts use; others are 0."""

    def __init__(self, notices: dict[str, str], coverage: float):
        self.names, self.coverage = [*notices], coverage
        texts = [words_of(t) for t in notices.values()]
        vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        self.vocabulary = vocabulary
        self.templates = [[vocabulary[w] for w in t] for t in texts]
        self.counts = np.zeros((len(texts), len(vocabulary) + 1), np.int64)
        for t, counts in zip(self.templates, self.counts, strict=True):
            np.add.at(counts, t, 1)
        self.special = [np.array(sorted({k for k in t if not {w for w, v in vocabulary.items() if v == k} & PLAIN}), np.int64) for t in self.templates]
        width = len(vocabulary) + 1
        self.pairs = [np.unique(np.array([x * width + y for x, y in zip(t, t[1:], strict=False)], np.int64)) for t in self.templates]
        family = self.family = [n.split("-")[0] for n in self.names]
        self.own = [set(t) - {w for u, f in zip(self.templates, family, strict=True) if f != g for w in u} for t, g in zip(self.templates, family, strict=True)]
        self.pieces = TwoGenerations(self.look, 200_000)

    def look(self, piece: str) -> tuple[int, ...]:
        return tuple(self.vocabulary.get(w, 0) for w in words_of(piece)) if piece else ()

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """License, coverage, matched words, and the first and last matched word of each place."""
        found = [*map(self.pieces.__getitem__, (text or "").split())]
        codes = np.fromiter((c for f in found for c in f), np.int64)
        if not len(codes):
            return []
        number = self.vocabulary.get("#", -1)
        codes = codes[np.concatenate([[True], (codes[1:] != codes[:-1]) | (codes[1:] != number)])]
        there = np.bincount(codes, minlength=self.counts.shape[1])
        there[0] = 0
        reach = np.minimum(there, self.counts).sum(1)
        out = []
        for k in np.flatnonzero(reach >= self.coverage * self.counts.sum(1)).tolist():
            out += [(k, *p) for p in self._places(k, codes)]
        # a text that contains another of its family explains its places, too
        return [(self.names[k], *p) for k, *p in _uncontained(out, self.family)]

    def _is_own(self, k: int, matched: list[int]) -> bool:
        """Half of the words that no other family has are matched."""
        own = {self.templates[k][q] for q in matched} & self.own[k]
        return 2 * len(own) >= len(self.own[k])

    def _places(self, k: int, codes: np.ndarray) -> list[tuple[float, int, int, int]]:
        """Coverage, matched words, and the first and last matched word of each place of a license text."""
        template, out = self.templates[k], []
        n = len(template)
        special = np.flatnonzero(np.isin(codes, self.special[k]))
        known = np.concatenate([[0], np.cumsum(np.isin(codes, template))])
        done = 0
        for p in special.tolist():
            begin, end = max(done, p - n // 4 - 2), min(len(codes), p + n + n // 4 + 2)
            if p < done or known[end] - known[begin] < self.coverage * n:
                continue
            pairs = patience(codes[begin:end].tolist(), template)
            while len(pairs) >= self.coverage * n:  # the window moves and grows with what is found
                (i, q), (j, r) = pairs[0], pairs[-1]
                low, high = max(done, begin + i - q - n // 4 - 2), min(len(codes), begin + j + n - r + n // 4 + 2)
                again = patience(codes[low:high].tolist(), template)
                if len(again) <= len(pairs):
                    break
                begin, pairs = low, again
            if len(pairs) >= self.coverage * n and self._is_own(k, [q for _, q in pairs]):
                out.append((len(pairs) / n, len(pairs), begin + pairs[0][0], begin + pairs[-1][0]))
                done = begin + pairs[-1][0] + 1
        if n < 2 * RUN:
            return out
        ends = [(0, -1)] + [(p[2], p[3]) for p in out] + [(len(codes), len(codes))]
        for (_, b), (e, _) in zip(ends, ends[1:], strict=False):
            out += self._chains(k, self._fragments(k, codes, b + 1, e))
        return sorted(out, key=lambda p: p[2])

    def _fragments(self, k: int, codes: np.ndarray, begin: int, end: int) -> list[list[tuple[int, int]]]:
        """Runs of RUN or more matched (text, license) places between two places of a text, in order."""
        template = self.templates[k]
        here = codes[begin:end]
        if len(here) < RUN:
            return []
        met = np.isin(here[:-1] * self.counts.shape[1] + here[1:], self.pairs[k])
        # a run has pairs of neighbours of the license text in half of its places
        met = np.concatenate([[0], np.cumsum(met)])
        width = min(2 * RUN, len(met) - 1)
        dense = np.flatnonzero(met[width:] - met[:-width] >= RUN // 2)
        out: list[list[tuple[int, int]]] = []
        done, reach = 0, len(template) + len(template) // 4
        for p in dense.tolist():
            if p < done:
                continue
            at = max(done, p)
            pairs = patience(here[at : at + reach].tolist(), template)
            run: list[tuple[int, int]] = []
            best: list[tuple[int, int]] = []
            for i, q in pairs:
                if run and (i - run[-1][0] > GAP or q - run[-1][1] > GAP):
                    if len(run) >= RUN:
                        break
                    run = []
                run.append((i, q))
            best = run
            if len(best) >= RUN:
                out.append([(begin + at + i, q) for i, q in best])
                done = at + best[-1][0] + 1
            else:
                done = p + RUN // 2
        return out

    def _chains(self, k: int, fragments: list[list[tuple[int, int]]]) -> list[tuple[float, int, int, int]]:
        """Places of fragments that follow one another in the license text, too."""
        out, chain, n = [], [], len(self.templates[k])

        def close() -> None:
            if len(chain) >= self.coverage * n and self._is_own(k, [q for _, q in chain]):
                out.append((len(chain) / n, len(chain), chain[0][0], chain[-1][0]))
            chain.clear()

        for f in fragments:
            if chain and f[0][1] <= chain[-1][1]:
                beyond = [m for m in f if m[1] > chain[-1][1]]
                if len(beyond) < RUN:  # the text begins again
                    close()
                else:
                    f = beyond
            chain.extend(f)
        close()
        return out


def _uncontained(places: list[tuple[int, float, int, int, int]], family: list) -> list[tuple[int, float, int, int, int]]:
    """The places (license, coverage, matched, first, last) that lie within no place of another license of their family with more matched words.

    A sweep from the last end to the first: of the places that end no sooner, each license keeps the most matched
    words by where they begin, as maxima of a binary indexed tree.
    """
    begins = {b: k + 1 for k, b in enumerate(sorted({p[3] for p in places}))}
    best: dict[int, list[int]] = {p[0]: [0] * (len(begins) + 1) for p in places}
    kept = []
    by_end = sorted(range(len(places)), key=lambda i: -places[i][4])
    for _, group in itertools.groupby(by_end, key=lambda i: places[i][4]):
        same = list(group)
        for i in same:
            license, _, matched, first, _ = places[i]
            k, tree = begins[first], best[license]
            while k < len(tree):
                tree[k] = max(tree[k], matched)
                k += k & -k
        for i in same:
            license, _, matched, first, _ = places[i]
            most = 0
            for other, tree in best.items():
                k = begins[first] if other != license and family[other] == family[license] else 0
                while k:
                    most = max(most, tree[k])
                    k -= k & -k
            if most <= matched:
                kept.append(i)
    return [places[i] for i in sorted(kept)]


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, matched words, first and last matched word, of every place of every document."""
    names = ["license", "coverage", "matched", "first_word", "last_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with calm_gc():
            scanner = Scanner(notices, coverage)
            for batch in batches:
                rows = [(k, *f) for k, text in enumerate(batch.column(1).to_pylist()) for f in scanner.scan(text)]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[c + 1] for r in rows], t) for c, t in enumerate(kinds))], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, license string, coverage double, matched long, first_word long, last_word long")
