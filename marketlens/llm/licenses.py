"""License scans: winnowed fingerprints pick candidates, banded alignment reports spans."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import textbytes as tb
from marketlens.llm.winnowing import grams, winnow

SHORT = 24  # templates of fewer words are looked up by single words, all of them
SPAN = 6  # a longer run of shared words is never asked for
BAND = 12  # how far an alignment may stray, in words
LEAST_COVERAGE = 0.6
TEMPLATE_BYTES = 8 << 20  # templates that a task holds
CELLS = 1 << 20  # cells of an alignment's band worked on at once

# Common license notices, the words as their authors publish them.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for
        more details.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
        SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
        SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
        PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
        ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
        OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
}
# The words without which a short notice or a header does not name its license.
KEYS = {
    "AGPL-3.0": "affero 3", "AGPL-3.0-header": "affero 3", "Apache-2.0": "apache 2", "Apache-2.0-header": "apache 2",
    "CC-BY-4.0": "commons attribution 4", "CC-BY-4.0-short": "cc by 4", "CC-BY-NC-4.0": "cc nc 4",
    "CC-BY-NC-4.0-long": "commons noncommercial 4", "CC-BY-NC-ND-4.0": "cc nc nd 4", "CC-BY-NC-ND-4.0-long": "commons noncommercial noderivatives 4",
    "CC-BY-NC-SA-4.0": "cc nc sa 4", "CC-BY-NC-SA-4.0-long": "commons noncommercial sharealike 4", "CC-BY-ND-4.0": "cc nd 4",
    "CC-BY-ND-4.0-long": "commons noderivatives 4", "CC-BY-SA-4.0": "cc sa 4", "CC-BY-SA-4.0-long": "commons sharealike 4",
    "GPL-2.0": "general 2", "GPL-2.0-header": "general 2", "GPL-3.0": "general 3", "GPL-3.0-header": "general 3",
    "LGPL-2.1": "lesser 2 1", "LGPL-3.0": "lesser 3", "MIT": "mit", "MPL-2.0-header": "mozilla 2",
}

# A cell of the alignment packs its score, its matched words and where it began, greatest first.
_SCORE, _HIT, _PART = np.int64(1) << np.int64(42), np.int64(1) << np.int64(21), np.int64((1 << 21) - 1)


def templates(spark: SparkSession) -> DataFrame:
    """The notices above as ``(license, text, key)``."""
    return spark.createDataFrame([(n, t, KEYS.get(n)) for n, t in sorted(TEMPLATES.items())], "license string, text string, key string")


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tb.texts(column)
    data = tb.LOWER[data]
    start, end, first = tb.word_spans(data, offsets, tb.ALNUM)
    return tb.word_hashes(data, start, end), first


def _fingerprints(words: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of which any ``span`` shared words have one in common: of up to two words each
    of their grams, a window of one gram, else the least grams of windows."""
    if span > 2:
        return winnow(words, first, span)
    at = np.arange(len(words))
    if span == 1:
        return at, words
    whole = np.ones(len(words), bool)
    whole[first[1:][np.diff(first) > 0] - 1] = False
    at = at[whole]
    return at, grams(words, 2)[at] if len(at) else np.zeros(0, np.uint64)


class TemplateIndex:
    """Words of the templates and their fingerprints in an inverted index.

    How long a shared run must be follows from the share of words that must match: with ``need``
    matched words the others split them into at most ``others + 1`` runs, one of which has
    ``span`` words. Where fingerprints are dense, a candidate needs several of them in its band."""

    def __init__(self, names: list[str], words: np.ndarray, first: np.ndarray, least: float = LEAST_COVERAGE, key: np.ndarray | None = None, key_first: np.ndarray | None = None):
        size = np.diff(first)
        if len(size) and size.max() > 1 << 19:
            raise ValueError("a template has more than 524,288 words")
        self.names, self.words, self.first, self.size = names, words, first, size
        self.key = [set() if key is None else set(key[key_first[i] : key_first[i + 1]].tolist()) for i in range(len(names))]
        self.of = np.repeat(np.arange(len(names)), size)
        self.need = np.array([max(1, math.ceil(least * n - 1e-9)) for n in size], np.int64)
        others = np.maximum(size - self.need, 0)
        run = np.where(size < SHORT, 1, np.clip((self.need - 1) // (others + 1) + 1, 2, SPAN))
        # Each word changed or left out costs two grams of two words; half of the rest may go by words put in.
        self.shared = np.select([run == 1, run == 2], [self.need, np.maximum(1, (size - 1 - 2 * others) // 2)], 1)
        self.levels = []
        for span in np.unique(run[size > 0]):
            mine = np.flatnonzero((run == span) & (size > 0))
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in mine])
            pos, h = _fingerprints(words[at], np.concatenate([[0], np.cumsum(size[mine])]), int(span))
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[h & np.uint64(0xFFFF)] = True
            self.levels.append((int(span), h[order], at[pos[order]], seen))

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, template, least shift) of bands with enough shared fingerprints. A shift is a
        place in the text less the place in the template; a band, the shifts of two cells beside
        each other, so an alignment that strays no more than ``BAND`` words lies in one."""
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        most = int(self.size.max(initial=0))
        cells = (len(words) + most) // BAND + 3  # one more than can be, between templates
        found = []
        for span, keys, places, seen in self.levels:
            pos, h = _fingerprints(words, first, span)
            likely = seen[h & np.uint64(0xFFFF)]
            pos, h = pos[likely], h[likely]
            lo = np.searchsorted(keys, h, "left")
            n = np.searchsorted(keys, h, "right") - lo
            pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
            p = np.repeat(pos, n)
            q = places[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            t = self.of[q]
            cell = (p - (q - self.first[t]) + most) // BAND
            bands, count = np.unique((text_of[p] * len(self.names) + t) * cells + cell, return_counts=True)
            beside = np.zeros(len(bands), np.int64)
            if len(bands) > 1:
                beside[:-1] = np.where(bands[1:] == bands[:-1] + 1, count[1:], 0)
            enough = np.flatnonzero(count + beside >= self.shared[bands // cells % len(self.names)])
            found.append(bands[np.unique(enough + (beside > count)[enough])])
        if not found:
            return (np.zeros(0, np.int64),) * 3
        bands = np.concatenate(found)
        pair = bands // cells
        return pair // len(self.names), pair % len(self.names), bands % cells * BAND - most

    def align(self, words, low, high, template, shift):
        """Best local alignment of each candidate within its band and between the places ``low``
        and ``high``: (matched words, begin, end).

        Rows are the template's words, columns the band around the shift. A matched word counts
        2, a word changed or left out on either side -1. Of equal scores the one with more
        matched words is better, then the shorter. Candidates advance together, a row at a time:
        words left out of the template come down a column, words put into the text along the row
        as a running maximum."""
        matched, begin, end = (np.zeros(len(template), np.int64) for _ in range(3))
        wide = 3 * BAND
        column = np.arange(wide, dtype=np.int64)[:, None]
        for t in np.unique(template):
            own = self.words[self.first[t] : self.first[t + 1]]
            deep = len(own) + wide
            every = np.flatnonzero(template == t)
            step = max(1, CELLS // deep)
            for rows in (every[i : i + step] for i in range(0, len(every), step)):
                base = shift[rows] - BAND
                at = base + np.arange(deep)[:, None]
                inside = (at >= low[rows]) & (at < high[rows])
                shown = words[np.clip(at, 0, len(words) - 1)]
                cell = np.zeros((wide + 1, len(rows)), np.int64)
                best, stop = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                for i, w in enumerate(own):
                    within = inside[i : i + wide]
                    both = np.where(cell[:wide] == 0, column + i, cell[:wide])
                    both += np.where(shown[i : i + wide] == w, 2 * _SCORE + _HIT, -_SCORE)
                    here = np.where(within, np.maximum(both, cell[1:] - _SCORE), 0)
                    here += column * _SCORE
                    np.maximum.accumulate(here, axis=0, out=here)
                    here -= column * _SCORE
                    cell[:wide] = np.where(within & (here >= _SCORE), here, 0)
                    top = cell[:wide].max(axis=0)
                    better = np.flatnonzero(top > best)
                    if len(better):
                        best[better] = top[better]
                        stop[better] = i + cell[:wide, better].argmax(axis=0) + 1
                matched[rows] = (best // _HIT) & _PART
                begin[rows], end[rows] = base + (best & _PART), base + stop
        return matched, begin, end

    def matches(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, template, matched, begin, end) of all spans with enough matched words and the
        template's key words. What lies on either side of a span is aligned again."""
        text, template, shift = self.candidates(words, first)
        low, high = first[text], first[text + 1]
        found = []
        while len(text):
            matched, begin, end = self.align(words, low, high, template, shift)
            good = np.flatnonzero(matched >= self.need[template])
            for k in good:
                if self.key[template[k]].issubset(words[begin[k] : end[k]].tolist()):
                    found.append((int(text[k]), int(template[k]), int(matched[k]), int(begin[k]), int(end[k])))
            side = np.concatenate([good, good])
            low, high = np.concatenate([low[good], end[good]]), np.concatenate([begin[good], high[good]])
            text, template, shift = text[side], template[side], shift[side]
            reach = np.minimum(high, shift + 2 * BAND + self.size[template]) - np.maximum(low, shift - BAND)
            left = reach >= self.need[template]
            text, template, shift, low, high = text[left], template[left], shift[left], low[left], high[left]
        return found


def _scanned(column: pa.Array, index: TemplateIndex) -> list[pa.Array]:
    words, first = _words(column)
    found: list[list] = [[] for _ in range(len(column))]
    taken: list[list] = [[] for _ in range(len(column))]
    size = index.size
    for x, t, matched, begin, end in sorted(index.matches(words, first), key=lambda m: (m[0], -m[2], -m[2] / size[m[1]], m[3], index.names[m[1]])):
        place = bisect.bisect(taken[x], (begin, end))
        if (place and taken[x][place - 1][1] > begin) or (place < len(taken[x]) and taken[x][place][0] < end):
            continue
        taken[x].insert(place, (begin, end))
        at = int(first[x])
        found[x].append({"license": index.names[t], "coverage": matched / int(size[t]), "matched": matched, "begin": begin - at, "end": end - at})
    for mine in found:
        mine.sort(key=lambda m: m["begin"])
    return [pa.array(np.diff(first)), pa.array(found, MATCHES)]


FOUND = "n_words long, licenses array<struct<license:string,coverage:double,matched:long,begin:long,end:long>>"
MATCHES = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, notices: DataFrame, text: str = "text", least: float = LEAST_COVERAGE, template_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """The frame's columns but the text, ``n_words``, and ``licenses``: an array of ``license,
    coverage, matched, begin, end``, the spans in words of the document.

    ``notices(license, text[, key])`` are the templates, at most ``template_bytes`` of text; null
    names or texts without words are left out. A span counts if its best alignment matches at least
    the share ``least`` of the template's words in order, and it holds all words of ``key``. Spans
    that overlap compete: the one with more matched words stays, then the one of greater coverage,
    the earlier, the first by name. Templates below ``SHORT`` words miss no such span that strays
    at most ``BAND`` words from its template; longer ones need a run of shared words, which every
    span has unless words were put in between almost all of its matched words.

    A null or empty text has no words and no licenses; every row, repeated ones too, has its own
    result; columns named like a result are replaced; empty tables give empty results. Documents
    are read once and not shuffled."""
    if "key" not in notices.columns:
        notices = notices.withColumn("key", F.lit(None).cast("string"))
    rows = notices.select(*(F.col(c).cast("string").alias(c) for c in ("license", "text", "key"))).filter("license IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    if size > template_bytes:
        raise ValueError(f"templates have {size} bytes, more than {template_bytes}; scan for them in several runs")
    rows = rows.orderBy("license", "text", "key").toArrow()
    names = rows.column("license").to_pylist()
    none = (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    words, first = _words(rows.column("text").combine_chunks()) if len(rows) else none
    key, key_first = _words(rows.column("key").combine_chunks()) if len(rows) else none
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(names, words, first, least, key, key_first))
    return tb.with_columns(docs, text, FOUND, lambda column: _scanned(column, index.value), keep_text=False)
