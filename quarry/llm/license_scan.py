"""License scans by patience alignment.

For each text and each license template, words that are unique in both anchor an alignment; the longest
increasing subsequence of the anchors stays, and the gaps between them are aligned in the same way after matching their
equal ends. Coverage is the share of the template's words that are matched.

Where to align: a text that covers `least` of a template of n words lacks fewer than (1 - least) * n + 1 of its words, so
of that many of its words (the longest are taken, as the rarest) it holds at least one. Around every occurrence of such a probe
in the text, the stretch where the template would lie is aligned: with half its length to either side, to one side, and as it is, as next to other
notices the words of a wide stretch repeat and anchor nothing. The most matched words count, then the shortest span. So repeated
notices are found one by one, a text without probes costs one scan, and whole texts of any length are read. A notice that is broken by an insertion is found as long as
what stands in the stretch reaches `least`: one that pushes more than (1 - least) of it beyond half its length is missed.

Words are runs of ASCII letters and digits, in lower case. Defined results: null and empty texts yield no row; rows with equal ids, or without one, are scanned one by one; ties
of coverage go to the earlier stretch; an empty table, or one without notices, gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import binary

LEAST = 0.8
WORD = re.compile(rb"[a-z0-9]+").findall

#: Common short license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit": "Released under the MIT License",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}

#: Full license texts.
FULL_TEXTS = {
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "bsd-3-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS "
        "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND "
        "ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
        "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched index pairs of two word lists, increasing in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        chain = increasing(anchors)
        if chain:
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            pairs += chain
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


def increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with increasing second members, by patience sorting."""
    tops, piles, before = [], [], []
    for n, (_, j) in enumerate(anchors):
        k = bisect_left(tops, j)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[k], piles[k] = j, n
    chain, n = [], piles[-1] if piles else -1
    while n >= 0:
        chain.append(anchors[n])
        n = before[n]
    return chain[::-1]


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, WORD(text.lower().encode())
        self.needed = -(-len(self.words) * round(least * 1000) // 1000)
        rare = sorted(range(len(self.words)), key=lambda i: (-len(self.words[i]), i))[: len(self.words) - self.needed + 1]
        self.probes = {self.words[i] for i in rare}
        self.places = {p: [i for i, w in enumerate(self.words) if w == p] for p in self.probes}

    def best(self, words: list[bytes], at: dict[bytes, list[int]]) -> tuple[int, int, int, int] | None:
        """(matched words, first and last matched word of the text, stretches that qualify), or None. at: positions of words."""
        n, found = len(self.words), []
        starts = sorted({p - i for probe in self.probes for p in at.get(probe, ()) for i in self.places[probe]})
        for s in starts:
            wide, slack = words[max(0, s - n // 2) : s + n + n // 2], n // 2
            there = set(wide)
            if sum(w in there for w in self.words) < self.needed:
                continue
            here = None
            for before, after in ((slack, slack), (0, 0), (0, slack), (slack, 0)):
                low = max(0, s - before)
                pairs = align(words[low : max(0, s + n + after)], self.words)
                if len(pairs) >= self.needed:
                    new = (len(pairs), low + pairs[0][0], low + pairs[-1][0])
                    here = new if here is None else min(here, new, key=lambda x: (-x[0], x[2] - x[1]))
                    if here[0] == n == here[2] - here[1] + 1:
                        break
            if here:
                found.append(here)
        if not found:
            return None
        spans, end = 0, -1
        for _, first, last in sorted(found, key=lambda x: x[2]):
            if first > end:
                spans, end = spans + 1, last
        matched, first, last = min(found, key=lambda x: (-x[0], x[1]))
        return matched, first, last, spans


def scan_text(text: bytes, templates: list[Template]) -> list[tuple]:
    low = text.lower()
    likely = [t for t in templates if any(p in low for p in t.probes)]
    if not likely:
        return []
    words = WORD(low)
    wanted = set().union(*(t.probes for t in likely))
    at: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in wanted:
            at.setdefault(w, []).append(i)
    return [(t.name, len(t.words), *best) for t in likely if (best := t.best(words, at))]


_NAMES = ["license", "template_words", "matched_words", "first_word", "last_word", "occurrences"]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license it covers: doc_id, license, coverage, matched_words, template_words, first_word, last_word (positions of the best stretch), occurrences."""
    texts = templates or TEMPLATES | FULL_TEXTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Template(name, text, least) for name, text in texts.items()]
        for batch in batches:
            rows = [(i, *r) for i, t in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True) if t for r in scan_text(t, made)]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", *_NAMES])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = source.mapInArrow(run, "doc_id long, license string, template_words long, matched_words long, first_word long, last_word long, occurrences long")
    return found.withColumn("coverage", F.round(F.col("matched_words") / F.col("template_words"), 6))
