"""License scans by patience alignment of a text with license templates.

Where enough of a template's telling words stand together, that stretch of the text is aligned with the template:
the words that occur once in either anchor the alignment, the longest increasing subsequence of the anchors is kept,
and each gap between them is aligned in the same way. The coverage is the share of the template's words that are
aligned. A stretch with a coverage of `least` or more is a finding. Of two that share half of the aligned words
of the one with fewer, the one with more is kept, so that a license isn't taken for another that it contains.

A template of n words may leave (1 - least) n of them unaligned, so a stretch that holds fewer telling words than that
leaves room for can't reach the coverage. A stretch reaches as far as the template's telling words follow each other
at no more than 2 n words; it is aligned at twice the template's length first, and then at twice as much each time until it is found or
ends, so words may be put in between the template's as long as it goes on.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

LEAST = 0.8

# Short notices and texts of common licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/",
}
#: Words too common to tell a license.
COMMON = set("a all an and any are as at be but by can code copy do either file for form free from has have if in is it its later list may met more must no not of on one or other out person public see shall so source subject that the this to under use used version was whether will with work you your 0 1 2 3 4 v".encode().split())

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_with_places(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    low = text.lower()
    found = [m.span() for m in _WORD.finditer(low)]
    return [low[a:b] for a, b in found], found


def patience(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both: anchors unique to both, the longest increasing subsequence
    of them, and the same again between each two neighbours. Equal words at either end of a gap are paired first; a gap
    without anchors is aligned by its longest common subsequence."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i >= i_end or j >= j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {w: k for k, w in enumerate(b[j:j_end], j) if in_b[w] == 1}
        pairs = [(k, place[w]) for k, w in enumerate(a[i:i_end], i) if in_a[w] == 1 and w in place]
        if not (unique := bool(pairs)):
            # Nothing is unique: all equal words, of each word of a the last of b first, so that the chain has it once.
            places = {w: [y for y in range(j_end - 1, j - 1, -1) if b[y] == w] for w in in_b.keys() & in_a.keys()}
            pairs = [(k, y) for k, w in enumerate(a[i:i_end], i) for y in places.get(w, ())]
        if not pairs:
            continue
        # Longest increasing subsequence: piles by their top, and each card's card beneath.
        tops: list[int] = []
        at: list[int] = []
        beneath: list[int] = []
        for k, (_, y) in enumerate(pairs):
            pile = bisect_left(tops, y)
            tops[pile : pile + 1] = [y]
            at[pile : pile + 1] = [k]
            beneath.append(at[pile - 1] if pile else -1)
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = beneath[k]
        chain.reverse()
        out += chain
        if not unique:
            continue
        ends = [(i - 1, j - 1), *chain, (i_end, j_end)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.least = name, least
        self.words = words_with_places(text.encode())[0]
        own = Counter(self.words)
        self.telling = {w for w in own if w not in COMMON} or set(own)
        spare = int((1 - least) * len(self.words) + 1e-9)
        #: Distinct telling words that a stretch needs: each that is absent leaves a word of the template unaligned.
        self.needed = max(1, len(self.telling) - spare)

    def find(self, words: list[bytes], present: set[bytes]):
        """(first word, word after the last, coverage, aligned words) of findings from left to right, apart from each other."""
        telling = self.telling & present
        if len(telling) < self.needed:
            return
        seeds = [k for k, w in enumerate(words) if w in telling]
        # Where the text has none of the template's telling words for twice as long as the template is, it can't go on.
        apart = 2 * len(self.words)
        ends = [k for k, (x, y) in enumerate(zip(seeds, seeds[1:], strict=False)) if y - x > apart] + [len(seeds) - 1]
        done = 0
        for s, k in enumerate(seeds):
            if k < done:
                continue
            last = min(len(words), seeds[ends[bisect_left(ends, s)]] + apart + 1)
            # The shortest stretch that has enough, so that of two texts in a row each is found; each is twice the one before.
            reach = apart
            while True:
                stop = min(last, k + reach)
                if len({words[x] for x in seeds[s : bisect_left(seeds, stop)]}) >= self.needed:
                    # The template may begin before its first telling word.
                    pairs = patience(words[max(done, k - len(self.words)) : stop], self.words)
                    if len(pairs) >= self.least * len(self.words):
                        pairs = self._continued(words, [(x + max(done, k - len(self.words)), y) for x, y in pairs], done, last)
                        done = pairs[-1][0] + 1
                        yield pairs[0][0], done, len(pairs) / len(self.words), {x for x, _ in pairs}
                        break
                if stop == last:
                    break
                reach *= 2

    def _continued(self, words: list[bytes], pairs: list[tuple[int, int]], first: int, last: int) -> list[tuple[int, int]]:
        """The pairs with those of the template's words before and after them, sought as far as these may reach at twice the
        words of text that the pairs take."""
        (start, head), (stop, tail) = pairs[0], pairs[-1]
        each = 2 * -(-(stop + 1 - start) // len(pairs))
        begin = max(first, start - each * head)
        before = patience(words[begin:start], self.words[:head])
        after = patience(words[stop + 1 : min(last, stop + 1 + each * (len(self.words) - tail - 1))], self.words[tail + 1 :])
        return [(x + begin, y) for x, y in before] + pairs + [(x + stop + 1, y + tail + 1) for x, y in after]


def scan(text: bytes | None, templates: list[Template]) -> list[dict]:
    if not text:
        return []
    every = set().union(*(t.telling for t in templates))
    present = every.intersection(_WORD.findall(text.lower()))
    if not any(len(t.telling & present) >= t.needed for t in templates):
        return []
    words, places = words_with_places(text)
    found = [(a, b, t.name, c, own) for t in templates for a, b, c, own in t.find(words, present)]
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (-len(x[4]), -x[3], x[2], x[0])):
        if all(2 * len(x[4] & y[4]) < len(x[4]) for y in kept):
            kept.append(x)
    out = []
    for a, b, name, coverage, _ in sorted(kept):
        start = len(text[: places[a][0]].decode("utf-8", "replace"))
        stop = start + len(text[places[a][0] : places[b - 1][1]].decode("utf-8", "replace"))
        out.append({"license": name, "start": start, "stop": stop, "coverage": coverage})
    return out


FOUND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("coverage", pa.float64())]))


def _scanning(texts: dict[str, str], least: float):
    def run(batches):
        templates = [Template(name, text, least) for name, text in texts.items()]
        for batch in batches:
            found = [scan(x.as_py(), templates) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, FOUND)], ["doc_id", "licenses"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id and licenses, an array of (license, start, stop, coverage) with code-point offsets, for every row of
    `docs` (doc_id, text). Findings of different templates may overlap, with less
    than half of the aligned words of either in both.

    Null and empty texts have none. Repeated rows and null ids each give a row; an empty table gives none; further
    columns are ignored. Templates are a small fixed table and go to the executors with the code.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_scanning(templates or TEMPLATES, least), f"doc_id {kind}, licenses array<struct<license:string,start:int,stop:int,coverage:double>>")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, how many findings, the best one (greatest coverage, then name), and all names, sorted."""
    found = license_scan(table(spark, sf_dir, "documents"))
    best = F.get(F.array_sort(F.transform("licenses", lambda x: F.struct((-x["coverage"]).alias("c"), x["license"].alias("l")))), 0)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",")
    some = F.size("licenses") > 0
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_found"), F.when(some, best["l"]).alias("license"), F.when(some, -best["c"]).alias("coverage"), names.alias("licenses"))
