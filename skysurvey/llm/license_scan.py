"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Method: templates are cut into lower-cased words of ASCII letters, digits and other
non-ASCII characters. Of the hashes of their three-word sequences, winnowing keeps the
smaller one of every two neighbours, and an inverted index maps each to its templates
and places. Texts are fingerprinted the same way in numpy; a text that repeats four or
more words in a row of a template must hit the index. Around the first hit of a template a
banded local alignment of words counts the matched template words and finds the span; its
words are taken out, and the next hit is aligned until none is left.

The index holds the templates only, so its size does not grow with the data; it is
part of the function sent to the executors.

A match is reported when at least ``least`` of the template's words are matched; of
matches that overlap by more than half of the shorter one, the one with more matched
words stays (then the higher coverage, then the name that sorts first).

Defined results: null and empty texts have no match and give no row; a text with
several notices gives a row each; repeated rows are scanned each; texts of any length
are scanned whole; an empty table gives an empty result; only the key and the text are
read. Spans are code points of the text, the end excluded.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skysurvey.llm.common import map_columns, text_input
from skysurvey.llm.ngram_join import GROUP, word_hashes

LEAST = 0.8
GRAM = 3
WINNOW = 2
#: Diagonals on either side of a hit's own that the alignment visits.
BAND = 12
MATCH, MISMATCH, GAP = 2, -1, -1

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_SEPARATORS = ~_ALNUM

# License notices in common use.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
        IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "gpl-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
}


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_hashes(np.frombuffer(text, np.uint8), _SEPARATORS)


def winnowed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, place) of the sequences that winnowing keeps."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return words[:0], np.zeros(0, np.int64)
    grams = words[:n].copy()
    for j in range(1, GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        grams ^= grams >> np.uint64(29)
    if n < WINNOW:
        return grams, np.arange(n)
    right = grams[1:] <= grams[:-1]
    places = np.unique(np.arange(n - 1) + right)
    return grams[places], places


class Index:
    """Templates and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [_words(templates[n].encode())[0] for n in self.names]
        self.lists = [w.tolist() for w in self.words]
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            # A text's window inside a notice is a window of its template, so both choose the same sequence of it.
            if len(words) < GRAM + WINNOW - 1:
                raise ValueError(f"template {self.names[t]!r} has fewer than {GRAM + WINNOW - 1} words")
            grams, places = winnowed(words)
            for g, p in zip(grams.tolist(), places.tolist()):
                postings[g].append((t, p))
        self.postings = dict(postings)
        self.keys = np.array(sorted(postings), np.uint64)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Which fingerprints are in the index."""
        if not len(self.keys):
            return np.zeros(len(grams), bool)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        return self.keys[at] == grams


def align(template: list[int], words: list[int], shift: int) -> tuple[int, int, int]:
    """(matched words, first word, last word + 1) of the best local alignment near the diagonal word = place + shift."""
    width = 2 * BAND + 1
    before = [(0, 0, -1)] * (width + 2)  # score, matches, first word; one column of margin
    best = (0, 0, -1, -1)
    for place, want in enumerate(template):
        row = [(0, 0, -1)] * (width + 2)
        low = place + shift - BAND
        for k in range(width):
            word = low + k
            if not 0 <= word < len(words):
                continue
            score, matches, first = before[k + 1]
            if words[word] == want:
                one = (score + MATCH, matches + 1, first if first >= 0 else word)
            else:
                one = (score + MISMATCH, matches, first)
            skip_template, skip_word = before[k + 2], row[k]
            two = (skip_template[0] + GAP, *skip_template[1:])
            three = (skip_word[0] + GAP, *skip_word[1:])
            one = max(one, two, three, key=lambda x: x[0])
            if one[0] > 0:
                row[k + 1] = one
                if one[0] > best[0]:
                    best = (*one, word + 1)
        before = row
    return best[1], best[2], best[3]


class Scanner:
    """Finds the templates' notices in texts."""

    def __init__(self, templates: dict[str, str], least: float):
        self.index = Index(templates)
        self.least = least

    def _notices(self, t: int, words: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(matched words, first word, last word + 1) of every notice of a template, from (diagonal, word) hits.

        The first hit's surroundings are aligned. A notice found takes its words and hits away
        from the others; where there is none, the hits near this diagonal and place go. This
        is repeated until no hit is left, so adjacent notices are found one after the other.
        """
        template, free, found = self.index.lists[t], words, []
        hits = sorted(hits)
        near = min(BAND, max(1, len(template) // 4))
        while hits:
            shift = hits[0][0]
            low = max(0, shift - BAND)
            part = free[low : shift + len(template) + BAND + 1].tolist()
            matched, first, last = align(template, part, shift - low)
            if matched >= self.least * len(template) and first >= 0:
                first, last = first + low, last + low
                found.append((matched, first, last))
                if free is words:
                    free = words.copy()
                free[first:last] = 0  # no word's hash
                rest = [h for h in hits if not first <= h[1] < last]
                hits = rest if len(rest) < len(hits) else hits[1:]
            else:
                hits = [h for h in hits if h[0] > shift + near]
        return found

    def scan(self, words: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, last word + 1, matched words) of a text's words."""
        by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for gram, word in hits:
            for t, place in self.index.postings[gram]:
                by_template[t].append((word - place, word))
        found = []
        for t, own in by_template.items():
            size = len(self.index.lists[t])
            found += [(-matched, -matched / size, self.index.names[t], first, last) for matched, first, last in self._notices(t, words, own)]
        kept: list[tuple] = []
        for x in sorted(set(found)):
            if all(min(x[4], y[4]) - max(x[3], y[3]) <= 0.5 * min(x[4] - x[3], y[4] - y[3]) for y in kept):
                kept.append(x)
        return [(name, -c, first, last, -m) for m, c, name, first, last in sorted(kept, key=lambda x: x[3])]

    def scan_all(self, texts: list[bytes]) -> list[list[tuple[str, float, int, int, int]]]:
        """Matches of every text, spans in code points."""
        out: list[list] = [[] for _ in texts]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP):
                size += len(texts[to]) + 1
                to += 1
            data = b"\n".join(texts[at:to])
            words, starts, ends = _words(data)
            grams, places = winnowed(words)
            hit = np.nonzero(self.index.hits(grams))[0]
            if len(hit):
                bounds = np.cumsum([0, *(len(t) + 1 for t in texts[at:to])])
                row = np.searchsorted(bounds, starts[places[hit]], "right") - 1
                by_row: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for r, g, p in zip(row.tolist(), grams[hit].tolist(), places[hit].tolist()):
                    by_row[r].append((g, p))
                for r, hits in by_row.items():
                    first, past = np.searchsorted(starts, bounds[r]), np.searchsorted(starts, bounds[r + 1])
                    text = texts[at + r]
                    for name, coverage, a, b, matched in self.scan(words[first:past], [(g, p - first) for g, p in hits if p + GRAM <= past]):
                        low, high = int(starts[first + a] - bounds[r]), int(ends[first + b - 1] - bounds[r])
                        begin = len(text[:low].decode("utf-8", "replace"))
                        out[at + r].append((name, coverage, begin, begin + len(text[low:high].decode("utf-8", "replace")), matched))
            at = to
        return out


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], least: float) -> Scanner:
    return Scanner(dict(templates), least)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per match: key, license, coverage, span_start, span_end, matched_words."""
    kind = docs.schema[key].dataType.simpleString()
    slim = text_input(docs, key, text=text).select(F.col(key).alias("key"), F.col("text").cast("binary").alias("text"))
    given = tuple(sorted((templates or TEMPLATES).items()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, *m) for k, ms in zip(batch.column(0).to_pylist(), _scanner(given, least).scan_all(batch.column(1).to_pylist())) for m in ms]
        kinds = [batch.column(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "license", "coverage", "span_start", "span_end", "matched_words"])

    return map_columns(slim, f"key {kind}, license string, coverage double, span_start bigint, span_end bigint, matched_words bigint", run).withColumnRenamed("key", key)
