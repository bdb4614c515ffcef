"""Licence scans with a generalised suffix automaton.

The automaton holds the words of all licence templates and phrases. A text's
words run through it, giving at each place the longest template substring that
ends there; its suffix links give what shorter ones other templates have there.
Where a template's match cannot grow it becomes a segment; segments of one
template chain, in order in both text and template, into covered spans. A chain
must cover enough of its template, and every version number in it. Of spans
that overlap, the one that covers most words stays, then the one that covers
most of its template, so a licence isn't taken for its neighbour.

The score is the largest share of a template that a span covers; a text with a
base phrase alone scores the phrase's share of the shortest template around it.

Defined cases: a null or empty text has no words, labels or spans; repeated
rows get equal results; an empty table gives an empty result; other columns
are ignored; equal spans go to the smaller label; very long texts take time in
proportion to their words and segments.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docmill.llm.columns import id_type, map_texts, utf8_values

#: Word bytes are digits, small letters and all of non-ASCII; capitals are lowered first.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: The base phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Parts that several licences have.
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
NO_WARRANTY = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a "
    "copy of the GNU {name} along with this {work}."
)


def gnu_notice(name: str, version: str, later: bool, work: str = "program") -> str:
    """The notice of a GNU licence."""
    which = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return (
        f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as "
        f"published by the Free Software Foundation; {which} This {work} " + NO_WARRANTY.format(name=name, work=work)
    )


GPL, LESSER, AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"

#: Notices and whole texts of licences, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("gpl-2.0-only", gnu_notice(GPL, "2", False)),
    ("gpl-2.0-or-later", gnu_notice(GPL, "2", True)),
    ("gpl-3.0-only", gnu_notice(GPL, "3", False)),
    ("gpl-3.0-or-later", gnu_notice(GPL, "3", True)),
    ("lgpl-2.1-only", gnu_notice(LESSER, "2.1", False, "library")),
    ("lgpl-2.1-or-later", gnu_notice(LESSER, "2.1", True, "library")),
    ("lgpl-3.0-only", gnu_notice(LESSER, "3", False)),
    ("lgpl-3.0-or-later", gnu_notice(LESSER, "3", True)),
    ("agpl-3.0-only", gnu_notice(AFFERO, "3", False)),
    ("agpl-3.0-or-later", gnu_notice(AFFERO, "3", True)),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("bsd-2-clause", BSD_CONDITIONS + BSD_DISCLAIMER),
    ("bsd-3-clause", BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)

#: A segment has at least so many words, or the whole template if that is shorter.
MIN_SEGMENT = 3
#: Words that may lie between two segments of a chain, in the text and in the template.
MAX_GAP = 12
#: Share of a template's words that its chain must cover for the template's label.
MIN_COVERAGE = 0.8
#: Words that a version number follows.
VERSION_LEADS = (b"version", b"v", b"by", b"nc", b"sa", b"attribution", b"noncommercial", b"sharealike", b"cc0")


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences; vocabulary numbers the words."""

    vocabulary: dict[bytes, int]
    moves: list[dict[int, int]]
    link: list[int]
    length: list[int]
    ends: list[list[tuple[int, int]]]  # (sequence, end place) of a state's strings, links' included
    phrases: list[list[tuple[int, int]]] = field(default_factory=list)  # (words, phrase) that end a state's strings


def words_of(text: bytes) -> list[bytes]:
    """The scan's words of a UTF-8 text."""
    return text.translate(FOLD).split()


def build_automaton(sequences: list[list[bytes]]) -> Automaton:
    """The automaton of all substrings of the sequences; matches never cross two of them."""
    vocabulary: dict[bytes, int] = {}
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    own: list[list[tuple[int, int]]] = [[]]

    def extended(last: int, w: int) -> int:
        if (q := moves[last].get(w)) is not None and length[q] == length[last] + 1:
            return q
        new = -1
        if q is None:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            own.append([])
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p < 0:
            return new
        q = moves[p][w]
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        twin = len(moves)
        moves.append(dict(moves[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        own.append([])
        while p >= 0 and moves[p].get(w) == q:
            moves[p][w] = twin
            p = link[p]
        link[q] = twin
        if new < 0:
            return twin
        link[new] = twin
        return new

    for k, sequence in enumerate(sequences):
        state = 0
        for place, word in enumerate(sequence):
            state = extended(state, vocabulary.setdefault(word, len(vocabulary)))
            own[state].append((k, place))
    for state in sorted(range(1, len(moves)), key=lambda s: -length[s]):
        own[link[state]].extend(own[state])
    return Automaton(vocabulary, moves, link, length, [sorted(set(x)) for x in own])


def with_phrases(automaton: Automaton, phrases: list[list[bytes]]) -> Automaton:
    """Notes, at each state, the phrases that end its strings, longest first."""
    ends: dict[int, list[tuple[int, int]]] = {}
    for k, phrase in enumerate(phrases):
        state = 0
        for word in phrase:
            state = automaton.moves[state][automaton.vocabulary[word]]
        ends.setdefault(state, []).append((len(phrase), k))
    automaton.phrases = []
    for state in range(len(automaton.moves)):
        found, s = [], state
        while s > 0:
            found += ends.get(s, [])
            s = automaton.link[s]
        automaton.phrases.append(sorted(found, reverse=True))
    return automaton


def matching_statistics(automaton: Automaton, words: list[bytes], shortest: int = 2) -> Iterator[tuple[int, int, int]]:
    """(place, state, length) of the longest match that ends at each place, where it has shortest words or more.

    Words that no template has reset the match, so only runs of known words are walked.
    """
    known = automaton.vocabulary.get
    moves, link, length = automaton.moves, automaton.link, automaton.length
    state = matched = 0
    for place, w in enumerate(map(known, words)):
        if w is None:
            state = matched = 0
            continue
        while state and w not in moves[state]:
            state = link[state]
            matched = length[state]
        if (to := moves[state].get(w)) is not None:
            state, matched = to, matched + 1
            if matched >= shortest:
                yield place, state, matched


def version_places(words: list[bytes]) -> frozenset[int]:
    """Places of a template's version numbers."""
    found: set[int] = set()
    for i, w in enumerate(words):
        if i and w.isdigit() and (words[i - 1] in VERSION_LEADS or i - 1 in found):
            found.add(i)
    return frozenset(found)


@dataclass
class Scanner:
    """Templates, phrases and their automaton."""

    templates: list[tuple[str, list[bytes]]]
    labels: list[str]  # of the phrases
    shares: list[float]  # of each phrase in the shortest template around it
    automaton: Automaton
    least: int  # words of a segment

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str, float]], list[tuple[str, int, int, float]]]:
        """Words, base places as (start, label, share), and covered spans as (label, first word, last word, coverage)."""
        words = words_of(text)
        base: list[tuple[int, str, float]] = []
        segments: dict[int, list[tuple[int, int, int]]] = {}
        growing: dict[tuple[int, int], tuple[int, int]] = {}  # place and length by template and end place less place
        for place, state, matched in matching_statistics(self.automaton, words):
            for n, k in self.automaton.phrases[state]:
                if n <= matched:
                    base.append((place - n + 1, self.labels[k], self.shares[k]))
            for k, end, n in self.matches(state, matched):
                before = growing.get((k, end - place))
                if before and before != (place - 1, n - 1):
                    segments.setdefault(k, []).append(self.segment(end - place, *before))
                growing[k, end - place] = place, n
        for (k, shift), before in growing.items():
            segments.setdefault(k, []).append(self.segment(shift, *before))
        return len(words), base, best_apart(span for k, own in segments.items() for span in self.chained(k, sorted(own)))

    def matches(self, state: int, matched: int) -> Iterator[tuple[int, int, int]]:
        """(template, end, length) of the longest match in each template's places that ends here."""
        seen: set[tuple[int, int]] = set()
        while state > 0 and matched >= self.least:
            for k, end in self.automaton.ends[state]:
                if k < len(self.templates) and (k, end) not in seen and matched >= min(MIN_SEGMENT, len(self.templates[k][1])):
                    seen.add((k, end))
                    yield k, end, matched
            state = self.automaton.link[state]
            matched = self.automaton.length[state]

    @staticmethod
    def segment(shift: int, place: int, n: int) -> tuple[int, int, int]:
        """(start in the text, start in the template, length)."""
        return place - n + 1, place + shift - n + 1, n

    def chained(self, k: int, own: list[tuple[int, int, int]]) -> Iterator[tuple[int, str, int, int, float]]:
        """(covered words, label, first word, last word, coverage) of a template's chains that cover enough of it."""
        label, words = self.templates[k]
        versions = version_places(words)
        best: list[tuple[int, int]] = []  # covered words, index of the segment before
        first_near = 0
        for i, (start, at, n) in enumerate(own):
            cover, before = n, -1
            while own[first_near][0] + len(words) + MAX_GAP < start:
                first_near += 1
            for j in range(first_near, i):
                s, t, m = own[j]
                shift = max(0, s + m - start, t + m - at)
                if s < start and t < at and shift < n and start - s - m <= MAX_GAP and at - t - m <= MAX_GAP and best[j][0] + n - shift > cover:
                    cover, before = best[j][0] + n - shift, j
            best.append((cover, before))
        for i in sorted(range(len(own)), key=lambda i: (-best[i][0], own[i])):
            cover, j = best[i][0], i
            if cover < MIN_COVERAGE * len(words):
                break
            covered = set(range(own[i][1], own[i][1] + own[i][2])) & versions
            while best[j][1] >= 0:
                j = best[j][1]
                covered |= set(range(own[j][1], own[j][1] + own[j][2])) & versions
            if covered == versions:
                yield cover, label, own[j][0], own[i][0] + own[i][2] - 1, min(1.0, cover / len(words))


def best_apart(spans: Iterable[tuple[int, str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The spans that overlap no better one, in order of place."""
    firsts: list[int] = []
    lasts: list[int] = []
    kept = []
    for _, label, first, last, coverage in sorted(spans, key=lambda s: (-s[0], -s[4], s[1], s[2], s[3])):
        place = bisect_left(lasts, first)
        if place == len(firsts) or firsts[place] > last:
            firsts.insert(place, first)
            lasts.insert(place, last)
            kept.append((label, first, last, coverage))
    return sorted(kept, key=lambda s: s[1:])


def build_scanner(
    templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES
) -> Scanner:
    """A scanner of the given licence texts and base phrases."""
    known = [(label, words_of(text.encode())) for label, text in templates]
    short = [words_of(x.encode()) for x in phrases]
    automaton = build_automaton([w for _, w in known] + short)

    def share(phrase: list[bytes]) -> float:
        around = [len(w) for _, w in known if any(w[i : i + len(phrase)] == phrase for i in range(len(w)))]
        return len(phrase) / min(around, default=len(phrase))

    return Scanner(known, list(phrases.values()), [share(x) for x in short], with_phrases(automaton, short), min([MIN_SEGMENT, *(len(w) for _, w in known)]))


def scan_licences(
    docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, base places (start, label, share) and spans (label, first_word, last_word, coverage) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner or build_scanner())
    place = pa.struct([("start", pa.int64()), ("label", pa.string()), ("share", pa.float64())])
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.scan(x) for x in utf8_values(batch.column(1))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[dict(zip(place.names, x)) for x in b] for _, b, _ in found], pa.list_(place)),
                pa.array(
                    [[dict(zip(span.names, s)) for s in spans] for _, _, spans in found], pa.list_(span)
                ),
            ],
            names=["doc_id", "n_words", "base", "spans"],
        )

    schema = (
        f"doc_id {id_type(docs, id_col)}, n_words bigint, base array<struct<start: bigint, label: string, share: double>>, "
        "spans array<struct<label: string, first_word: bigint, last_word: bigint, coverage: double>>"
    )
    return map_texts(docs, run, schema, id_col, text_col)


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and coverage of every document."""
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(base) as bigint) n_base",
        "array_min(base.start) first_word",
        "array_max(base.start) last_word",
        "array_join(array_sort(array_distinct(base.label)), ',') base_labels",
        "array_join(array_sort(array_distinct(concat(base.label, spans.label))), ',') labels",
        "greatest(coalesce(array_max(spans.coverage), 0D), coalesce(array_max(base.share), 0D)) score",
        "cast(size(spans) as bigint) n_spans",
    )


QUERIES = {"op2_licence_scan": op2_licence_scan}
