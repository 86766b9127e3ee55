"""License scans by patience alignment.

A text is aligned with a template where it has words of the template that seed a search: the long ones, and so many
others that no alignment that suffices can lack them all. Words
that are in both once each are anchors; the longest increasing run of them is kept, and the gaps between anchors are
aligned in the same way, with common heads and tails where no word is unique to both. The share of the template's
words that is aligned is its coverage. Where that doesn't suffice, the longest common subsequence of window and
template decides.

Seeds only choose where to look: all places of all seeds are looked at, in windows around them, so long texts cost
no more than their seeds. A text that has enough of a template's words, but not in one window, is searched for a notice
with something in it, a page's header for instance: one of LONG words or more may have insertions of as many words as it has
and INSERTED more in all; a shorter one, besides a word here and there, one insertion of up to INSERTED words, with two
aligned words at least on either side. Every document has one row, of its best template, with a list
of all places of all templates that suffice.

Defined results: a null or empty text, and one without seeds, has no license and coverage 0; of templates that are
covered enough the one with most words aligned wins, else the one with the greatest coverage, of equals the earlier
in the list; repeated rows have the same result each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import _words as W
from pathloom.llm._shared import map_batches, table

#: Coverage from which a text counts as licensed.
LICENSED = 0.8
#: Words of so many letters are seeds.
SEED = 6
#: Words that are seeds only if others don't do.
COMMON = frozenset("a an and any are as at be by for from in is it not of on or that the this to under with you your work".split())
#: From so many words on a notice isn't put together by chance from words far apart.
LONG = 20
#: Words that may stand within a notice; within a long one as many more as it has.
INSERTED = 100

#: Names and texts of licenses and notices (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MPL-2.0-notice", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second increases."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        before[i] = ends[at - 1] if at else -1
        tails[at : at + 1] = [b]
        ends[at : at + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, both ascending."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = _increasing([(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place])
        if not anchors:
            continue
        out.extend(anchors)
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps.extend((x + 1, p, y + 1, q) for (x, y), (p, q) in zip(ends, ends[1:], strict=False) if p > x + 1 and q > y + 1)
    return sorted(out)


def _rows(a: Sequence[str], marks: dict[str, int], n: int) -> Iterator[int]:
    """After each word of a, bit j is unset if one more of the n words is common up to j (Hyyrö's bit vectors)."""
    full = row = (1 << n) - 1
    for w in a:
        if m := marks.get(w, 0):
            row = (row + (row & m) | row - (row & m)) & full
        yield row


def marks_of(words: Sequence[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for j, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << j
    return out


def common(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """The longest common subsequence, as align() gives pairs."""
    n = len(b)
    rows = [(1 << n) - 1, *_rows(a, marks_of(b), n)]
    count = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    out, i, j = [], len(a), n
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif count(i - 1, j) == count(i, j):
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


class Template:
    def __init__(self, name: str, text: str) -> None:
        self.name, self.words = name, words_of(text)
        n = len(self.words)
        self.need = next((k for k in range(n) if k / n >= LICENSED), n)
        self.counts, self.marks = Counter(self.words), marks_of(self.words)
        self.at: dict[str, list[int]] = {}
        for j, w in enumerate(self.words):
            self.at.setdefault(w, []).append(j)
        # At most n - need places of the template are missing, so of more places one has its word in the text.
        self.seeds: set[str] = set()
        places = 0
        for w in sorted(self.counts, key=lambda w: (len(w) < SEED, w in COMMON, -len(w), w)):
            if len(w) >= SEED or places <= n - self.need:
                self.seeds.add(w)
                places += self.counts[w]

    def may_have(self, words: Sequence[str]) -> bool:
        """Whether so many of the template's words are there, in whatever order."""
        there = Counter(w for w in words if w in self.counts)
        return sum(min(c, there[w]) for w, c in self.counts.items()) >= self.need

    def best(self, words: list[str], places: dict[str, list[int]]) -> tuple[int, int, int]:
        """(words aligned, first, after the last) of the best place in the text."""
        found = (0, 0, 0)
        for place in self.tight(words, places):
            if place[0] > found[0]:
                found = place
                if place[0] == len(self.words):
                    break
        if found[0] < len(self.words):
            found = max([found, *self.wide(words, places)], key=lambda x: x[0])
        return found

    def all(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(words aligned, first, after the last) of all places that suffice, from the left to the right; they don't overlap."""
        out, stretches = [], [(0, len(words))]
        while stretches:
            begin, end = stretches.pop()
            part = words[begin:end]
            if not self.may_have(part):
                continue
            places = places_of(part, self.seeds)
            found = [x for x in self.tight(part, places) if x[0] >= self.need]
            taken: list[tuple[int, int, int]] = []  # (first, after the last, words aligned), ascending
            for n, lo, hi in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
                at = bisect_left(taken, (lo,))
                if (at == 0 or taken[at - 1][1] <= lo) and (at == len(taken) or hi <= taken[at][0]):
                    taken.insert(at, (lo, hi, n))
            if taken:
                # What is between these is looked at by itself.
                edges = [0, *(x for lo, hi, _ in taken for x in (lo, hi)), len(part)]
                stretches.extend((begin + a, begin + b) for a, b in zip(edges[::2], edges[1::2], strict=True))
            else:
                taken = [(lo, hi, n) for n, lo, hi in self.wide(part, places)]
            out.extend((n, begin + lo, begin + hi) for lo, hi, n in taken)
        return sorted(out, key=lambda x: x[1])

    def tight(self, words: list[str], places: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
        """The place in a window around each that a seed puts the template's beginning at; close ones are one."""
        n = len(self.words)
        begins = sorted({p - at for s in self.seeds if s in places for at in self.at[s] for p in places[s]})
        enough = bool(begins) and self.may_have(words)
        last = None
        for begin in begins:
            if last is not None and begin - last < max(2, n // 4):
                continue
            last = begin
            lo, hi = max(0, begin - n // 4 - 2), begin + n + n // 4 + 2
            pairs = align(words[lo:hi], self.words)
            if enough and len(pairs) < self.need and self.may_have(words[lo:hi]) and len(whole := common(words[lo:hi], self.words)) >= self.need:
                pairs = whole
            if pairs:
                yield len(pairs), lo + pairs[0][0], lo + pairs[-1][0] + 1

    def wide(self, words: list[str], places: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
        """Places that suffice, with something inserted, from the left to the right; they don't overlap."""
        if self.seeds.isdisjoint(places) or not self.may_have(words):
            return
        own = [(i, w) for i, w in enumerate(words) if w in self.counts]
        if len(self.words) >= LONG:
            yield from self._spread(own)
        else:
            yield from self._parted(own, sorted(p for s in self.seeds for p in places.get(s, ())))

    def _spread(self, own: list[tuple[int, str]]) -> Iterator[tuple[int, int, int]]:
        n = len(self.words)
        most = 2 * n + INSERTED
        back, index = marks_of(self.words[::-1]), [i for i, _ in own]
        begin = 0
        while begin < len(own):
            # All places of `most` words that begin in the first half of the block are in it.
            block = [w for _, w in own[begin : bisect_left(index, index[begin] + 2 * most)]]
            ends = (k for k, row in enumerate(_rows(block, self.marks, n)) if n - row.bit_count() >= self.need)
            # The first end, and for it the last begin, between which enough is common.
            end = next(ends, None) if self.may_have(block) else None
            if end is None:
                begin = bisect_left(index, index[begin] + most)
                continue
            size = next(k for k, row in enumerate(_rows(block[end::-1], back, n)) if n - row.bit_count() >= self.need)
            first, end = begin + end - size, begin + end
            if index[end] - index[first] >= most:
                begin = first + 1
                continue
            # The notice's rest is near.
            x = max(begin, bisect_left(index, index[first] - n // 4 - 2))
            pairs = common([w for _, w in own[x : bisect_left(index, index[end] + n // 4 + 3)]], self.words)
            yield len(pairs), index[x + pairs[0][0]], index[x + pairs[-1][0]] + 1
            begin = x + pairs[-1][0] + 1

    def _parted(self, own: list[tuple[int, str]], seeds: list[int]) -> Iterator[tuple[int, int, int]]:
        n = len(self.words)
        reach = n + n // 4 + 2 + INSERTED
        index = [i for i, _ in own]
        done = after_block = 0
        for p in seeds:
            if p < max(done, after_block):
                continue
            # All chains with a seed from p to p + reach are in here.
            near = own[bisect_left(index, max(done, p - reach)) : bisect_left(index, p + 2 * reach)]
            after_block = p + reach
            if not self.may_have([w for _, w in near]):
                continue
            pairs = [(i, j) for i, w in near for j in self.at[w]]
            # Of chains that end with a pair: (words, first place), without an insertion, with one word after it, with more.
            chains: list[list[tuple[int, int]]] = []
            for x, (i, j) in enumerate(pairs):
                best = [(1, -i), (0, 0), (0, 0)]
                for y in range(x - 1, -1, -1):
                    p0, q0 = pairs[y]
                    if i - p0 > n + INSERTED:
                        break
                    if p0 == i or q0 >= j:
                        continue
                    before, more = chains[y], (i - p0) - (j - q0)
                    if more <= n // 4 + 2:
                        after = max(before[1], before[2])
                        steps = [(0, before[0]), (2, after)]
                    else:
                        steps = [(1, before[0])] if more <= INSERTED and before[0][0] >= 2 else []
                    for k, (c, first) in steps:
                        if c:
                            best[k] = max(best[k], (c + 1, first))
                chains.append(best)
            found = max(((c, first, -i) for (i, _), chain in zip(pairs, chains, strict=True) for c, first in (chain[0], chain[2])), default=(0, 0, 0))
            if found[0] >= self.need:
                done, after_block = 1 - found[2], 0
                yield found[0], -found[1], done


def places_of(words: Sequence[str], wanted: set[str]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in wanted:
            places.setdefault(w, []).append(i)
    return places


def scan(text: str, templates: Sequence[Template]) -> tuple[str | None, float, int, int, int]:
    """(template, coverage, words aligned, first word, after the last word) of the best template."""
    words = words_of(text)
    places = places_of(words, set().union(*(t.seeds for t in templates)))
    top: tuple = (None, 0.0, 0, 0, 0)
    for t in templates:
        n, lo, hi = t.best(words, places)
        share = n / len(t.words)
        enough, before = share >= LICENSED, top[1] >= LICENSED
        # A notice may hold a shorter one, which it covers in full: of those that suffice, the one with more words.
        if (enough, n if enough else share, share) > (before, top[2] if before else top[1], top[1]):
            top = (t.name, share, n, lo, hi)
    return top


def notices(text: str, templates: Sequence[Template]) -> list[tuple[str, float, int, int, int]]:
    """What scan() gives, of all places of all templates that suffice, in the text's order; of different templates they may overlap."""
    words = words_of(text)
    found = [(t.name, n / len(t.words), n, lo, hi) for t in templates for n, lo, hi in t.all(words)]
    return sorted(found, key=lambda x: (x[3], -x[4]))


_NOTICE = ("license", "coverage", "n_matched", "first_word", "last_word")


def _scanner(templates: Sequence[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(*t) for t in templates]
        seeds = sorted(set().union(*(t.seeds for t in known)))
        wanted = W.hashes(W.split(pa.array([" ".join(seeds)], pa.string())))
        for batch in batches:
            for part in W.slices(batch, "text"):
                # Texts without a seed are told apart by the hashes of their words.
                w = W.split(part.column("text"), lower=True, between=W.SYMBOLS)
                some = np.zeros(part.num_rows, bool)
                some[w.owner()[np.isin(W.hashes(w), wanted)]] = True
                out = [scan(t, known) if hit else (None, 0.0, 0, 0, 0) for t, hit in zip(part.column("text").to_pylist(), some.tolist(), strict=True)]
                listed = [[dict(zip(_NOTICE, x, strict=True)) for x in notices(t, known)] if top[1] >= LICENSED else [] for t, top in zip(part.column("text").to_pylist(), out, strict=True)]
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                found = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found, pa.array(listed, pa.list_(pa.struct(list(zip(_NOTICE, kinds, strict=True)))))], names=["doc_id", *_NOTICE, "notices"])

    return run


def license_scan(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, license, coverage, n_matched, and the words from first_word up to last_word that it covers, of each document; notices: the same of all that suffice."""
    if not templates:
        raise ValueError("no templates")
    return documents.select("doc_id", "text").transform(map_batches, _scanner(templates), "doc_id long, license string, coverage double, n_matched long, first_word long, last_word long, notices array<struct<license: string, coverage: double, n_matched: long, first_word: long, last_word: long>>")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("licensed", F.col("coverage") >= LICENSED)
