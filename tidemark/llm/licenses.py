"""Licence scans: a generalised suffix automaton over the words of licence templates. A file's words
are streamed through it for matching statistics: at each word, the longest run ending there that stands
in a template. For each template its own longest run follows from the suffix links, so a template is not
hidden by another that matches longer. Runs of ``LEAST`` words or more that can't be prolonged are
anchors, at every place where they stand in the template, and are chained, in order and with bounded
gaps, by dynamic programming: the chain that covers most of the template's words is its span.

Words are runs of bytes outside ASCII punctuation, blanks and controls, after A-Z are lower-cased.
A template's label is found when its chain covers at least ``COVER`` of the template's words.
Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned
alike; of equal chains the first counts; a null ``doc_id`` stays null; a text of any length is
scanned in one pass; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import ship

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose places are counted one by one.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Openings and grants of common public licences, and whole texts of short ones.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("proprietary", "All rights reserved"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
COVER = 0.8
#: Shortest match, in words, that a chain may use, and the widest gap between two of its matches.
LEAST, GAP = 3, 12

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<label:string,first:long,last:long,share:double>>"
)


class SuffixAutomaton:
    """Automaton of all runs of words of several sequences. ``ends`` has, for each state, by sequence,
    every place where its runs end; ``reach`` has, by sequence, the nearest state over suffix links that
    the sequence has, of at least ``least`` words."""

    def __init__(self, sequences: list[list[int]], least: int = 1):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for x in sequence:
                last = self._extend(last, x)
        self.ends: list[dict[int, list[int]]] = [{} for _ in self.length]
        for which, sequence in enumerate(sequences):
            state = 0
            for at, x in enumerate(sequence):
                state = self.next[state][x]
                up = state
                while up > 0:
                    self.ends[up].setdefault(which, []).append(at + 1)
                    up = self.link[up]
        self.reach: list[dict[int, int]] = [{} for _ in self.length]
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            own = dict.fromkeys(self.ends[state], state) if self.length[state] >= least else {}
            self.reach[state] = {**self.reach[self.link[state]], **own}

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(moves)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        """A copy of ``q`` for the runs that reach it through ``p``, the shorter ones."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, x: int) -> int:
        if (q := self.next[last].get(x)) is not None:  # another sequence has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, x)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, x)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """The matching statistics: after each word, the state and length of the longest run."""
        state = length = 0
        for x in words:
            while state and x not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(x)) is not None:
                state, length = to, length + 1
            else:
                state = length = 0
            yield state, length

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """Runs of ``least`` words or more that a sequence has and that can't be prolonged in it to the
        right: sequence, end, length, the places where they end in the sequence."""
        open_: dict[int, tuple[int, int]] = {}
        for i, (state, length) in enumerate([*self.statistics(words), (0, 0)]):
            now = {}
            if length >= least:
                for t, at in self.reach[state].items():
                    now[t] = (length if at == state else self.length[at], at)
            for t, (n, at) in open_.items():
                if t not in now or now[t][0] != n + 1:
                    yield t, i, n, self.ends[at][t]
            open_ = now


def best_chain(matches: list[tuple[int, int, int]], gap: int) -> tuple[int, int, int]:
    """Words covered, first and last word of the best chain of ``matches``: (start in the text, start
    in the template, words), by start in the text. Matches come in both orders; an overlap counts once."""
    done: list[tuple[int, int, int, int, int]] = []  # text end, template end, text start, covered, first word
    best, open_from, widest = (0, 0, 0), 0, max((m[2] for m in matches), default=0)
    for a, b, n in matches:
        while open_from < len(done) and done[open_from][2] + widest + gap < a:
            open_from += 1
        covered, first = n, a
        for k in range(open_from, len(done)):
            end, tend, start, c, f = done[k]
            over = max(0, end - a, tend - b)
            if start < a and tend - (end - start) < b and a - end <= gap and over < n and c + n - over > covered:
                covered, first = c + n - over, f
        done.append((a + n, b + n, a, covered, first))
        if covered > best[0]:
            best = (covered, first, a + n - 1)
    return best


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.phrases = [(_WORD.findall(p.encode().lower()), label) for p, label in phrases.items()]
        texts = [(label, _WORD.findall(t.encode().lower())) for label, t in templates]
        texts += [(label, words) for words, label in self.phrases]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, t in texts for w in t), 1)}
        self.labels = [label for label, _ in texts]
        self.sizes = [len(t) for _, t in texts]
        self.least = min([LEAST, *self.sizes])
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in t] for _, t in texts], self.least)
        self.coded = [([self.vocabulary[w] for w in p], label) for p, label in self.phrases]

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Runs of words that all stand in some template: start, codes."""
        get, codes = self.vocabulary.get, []
        for i, x in enumerate(map(get, words)):
            if x:
                codes.append(x)
            elif codes:
                if len(codes) >= self.least:
                    yield i - len(codes), codes
                codes = []
        if len(codes) >= self.least:
            yield len(words) - len(codes), codes

    def spans(self, found: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int, float]]:
        """Template, first and last word, covered share of each template's best chain."""
        out = []
        for t, matches in sorted(found.items()):
            covered, first, last = best_chain(sorted(matches), GAP)
            out.append((t, first, last, covered / self.sizes[t]))
        return out

    def scan(self, text: str | None) -> tuple:
        words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
        places: list[tuple[int, str]] = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for start, codes in self.runs(words):
            for p, label in self.coded:
                n = len(p)
                places += [(start + i, label) for i in range(len(codes) - n + 1) if codes[i] == p[0] and codes[i : i + n] == p]
            for t, end, n, ends in self.automaton.matches(codes, self.least):
                found.setdefault(t, []).extend((start + end - n, e - n, n) for e in ends)
        shares = self.spans(found)
        base = sorted({label for _, label in places})
        spans = [(self.labels[t], first, last, s) for t, first, last, s in shares if s >= COVER]
        labels = sorted({*base, *(x[0] for x in spans)})
        starts = [s for s, _ in places]
        score = 1.0 if base else max((s for *_, s in shares), default=0.0)
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, sorted(set(spans))


@cache
def _scanner() -> Scanner:
    return Scanner(TEMPLATES, PHRASES)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Base phrases, licence labels, the largest covered share of a template, and the covered spans
    (label, first and last word, share); see ``SCHEMA``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        scanner = _scanner()
        for b in batches:
            rows = [scanner.scan(x.as_py()) for x in b.column(1)]
            rows = [(*r[:-1], [dict(zip(("label", "first", "last", "share"), s, strict=True)) for s in r[-1]]) for r in rows]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
