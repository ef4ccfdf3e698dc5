"""License scan: winnowed template fingerprints, then banded alignment.

Templates are cut into words. Hashes of three words in a row are winnowed (the least of
every three neighbours), and an inverted index maps them to places in templates. The texts
are winnowed alike, so any five words in a row that text and template share hit the index.
Hits on nearby diagonals are one candidate; a banded local alignment of its region against
the template gives the matched words and their span. A candidate counts if it covers enough
of the template. Templates are a fixed, bounded parameter and travel with the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import bounded
from quillspark.llm.shingles import WORD, window_hashes, word_hashes

GRAM, WINDOW = 3, 3
BAND = 8
COVERAGE = 0.8

# License texts and the notices that licenses ask for, as their own pages give them.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission."
)
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,'
    " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS"
    " BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE"
    " GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
    " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal'
    " in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
    " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,'
    " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
    " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS"
    " IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY'
    " AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM"
    " LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE."
)
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation,"
    " either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,"
    " but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    " You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
TEXTS = {
    "MIT": {"grant": _MIT_GRANT, "text": _MIT_GRANT + _MIT_WARRANTY},
    "ISC": {"grant": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.",
            "text": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.{_ISC_WARRANTY}"},
    "0BSD": {"text": f"{_ISC_GRANT}.{_ISC_WARRANTY}"},
    "BSD-2-Clause": {"text": _BSD + _BSD_WARRANTY},
    "BSD-3-Clause": {"conditions": _BSD + _BSD_THIRD, "text": _BSD + _BSD_THIRD + _BSD_WARRANTY},
    "Zlib": {"text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising"
             " from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it"
             " and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that"
             " you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not"
             " required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may"
             " not be removed or altered from any source distribution."},
    "BSL-1.0": {"text": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining"
                ' a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and'
                " transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all"
                " subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the"
                " following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies"
                " or derivative works are solely in the form of machine-executable object code generated by a source language processor."},
    "Unlicense": {"text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute"
                  " this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that"
                  " recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."},
    "Apache-2.0": {"header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
                   " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
                   ' software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
                   " See the License for the specific language governing permissions and limitations under the License."},
    "GPL-3.0": {"header": _GNU_HEADER.format(name="General Public License", version="3")},
    "GPL-2.0": {"header": _GNU_HEADER.format(name="General Public License", version="2")},
    "LGPL-3.0": {"header": _GNU_HEADER.format(name="Lesser General Public License", version="3")},
    "AGPL-3.0": {"header": _GNU_HEADER.format(name="Affero General Public License", version="3")},
    "MPL-2.0": {"header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,"
                " You can obtain one at http://mozilla.org/MPL/2.0/."},
    "CC0-1.0": {"notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."},
}
#: Names by which notices call the licenses.
NAMES = {
    "MIT": ["the MIT License"],
    "ISC": ["the ISC License"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "Zlib": ["the zlib License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0"],
    **{
        f"CC-{short}-4.0": [f"CC {short.replace('-', ' ', 1)} 4.0", f"a Creative Commons {name} 4.0 International License"]
        for short, name in {
            "BY": "Attribution",
            "BY-SA": "Attribution-ShareAlike",
            "BY-NC": "Attribution-NonCommercial",
            "BY-ND": "Attribution-NoDerivatives",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
            "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
        }.items()
    },
}
PHRASES = ("Licensed under {}", "Released under {}", "This work is licensed under {}", "Distributed under the terms of {}")


def templates() -> dict[tuple[str, str], str]:
    """Texts by (license, kind): full texts and headers, and notices by rule from names and phrases."""
    out = {(license_, kind): text for license_, kinds in TEXTS.items() for kind, text in kinds.items()}
    for license_, names in NAMES.items():
        for i, name in enumerate(names):
            out |= {(license_, f"notice {i}.{k}"): phrase.format(name) for k, phrase in enumerate(PHRASES)}
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of every ``window`` neighbours, the last of equals; of all
    hashes if there are fewer."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    least = window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(least + np.arange(len(views)))


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Banded local alignment (match 2, other steps -1): matched template words, and the first
    and one past the last text word of the best path. Text place = template place + diagonal,
    give or take ``band``. A row of the band is one step in numpy: along it, words of the text
    without one of the template cost 1 each, so the best cell to come from is a running maximum."""
    width = 2 * band + 1
    places = np.arange(width)
    score, matched, start = (np.zeros(width + 1, np.int64) for _ in range(3))
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        at = i + diagonal - band + places
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == word
        s, m = score[:-1] + np.where(same, 2, -1), matched[:-1] + same
        f = np.where(score[:-1] == 0, at, start[:-1])
        up = score[1:] - 1 > s  # a template word without a text word
        s, m, f = np.where(up, score[1:] - 1, s), np.where(up, matched[1:], m), np.where(up, start[1:], f)
        s = np.where(inside, np.maximum(s, 0), 0)
        run = np.maximum.accumulate(s + places)
        source = np.maximum.accumulate(np.where(s + places == run, places, 0))
        reached = np.where(inside, np.maximum(run - places, 0), 0)
        end = np.where(same & (s == reached) & (s > 0), s, 0)
        k = int(np.argmax(end))
        if end[k] > best[0]:
            best = (int(end[k]), int(m[k]), int(f[k]), int(at[k]) + 1)
        on = reached > 0
        score[:-1], matched[:-1], start[:-1] = reached, np.where(on, m[source], 0), np.where(on, f[source], 0)
    return best[1:]


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, given: Mapping[tuple[str, str], str]):
        self.names = sorted(given)
        self.words = [word_hashes(WORD.findall(given[n].lower())) for n in self.names]
        rows = [(h, t, int(p)) for t, w in enumerate(self.words) if len(w) >= GRAM for g in [window_hashes(w, GRAM)] for p in winnow(g) for h in [g[p]]]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)

    def _hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template, diagonal and place of all fingerprints that text and templates share, in that order."""
        grams = window_hashes(hashes, GRAM)
        known = self.keys[np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)] == grams
        at = winnow(grams) if known.any() else np.zeros(0, np.int64)
        at = at[known[at]]
        first, last = (np.searchsorted(self.keys, grams[at], side) for side in ("left", "right"))
        sizes = last - first
        row = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        place = np.repeat(at, sizes)
        template, diagonal = self.template[row], place - self.place[row]
        order = np.lexsort((place, diagonal, template))
        return template[order], diagonal[order], place[order]

    def matches(self, hashes: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
        """First and one past the last word, template and matched words, in the order of place.
        Hits of a template on nearby diagonals are one candidate."""
        template, diagonal, place = self._hits(hashes)
        found: list[tuple[int, int, int, int]] = []
        i, of, left = 0, -1, hashes
        while i < len(template):
            t, low = int(template[i]), int(diagonal[i])
            if t != of:
                left, of, end = hashes.copy(), t, int(np.searchsorted(template, t, "right"))
            until = i + int(np.searchsorted(diagonal[i:end], low + 2 * BAND, "right"))
            group, i = np.arange(i, until), until
            own = self.words[t]
            while len(group):  # a short template may stand there several times within the band
                low, high = int(diagonal[group].min()), int(diagonal[group].max())
                region = left[max(0, low - BAND - 1) : high + BAND + len(own) + 1]
                if np.isin(own, region).sum() < coverage * len(own):  # no alignment can match words that are not there
                    break
                matched, begin, stop = align(own, left, (low + high) // 2, BAND + (high - low + 1) // 2)
                if matched < coverage * len(own):
                    break
                found.append((begin, stop, t, matched))
                left[begin:stop] = 0
                group = group[(place[group] < begin) | (place[group] >= stop)]
        return self._fullest(sorted(found))

    def _fullest(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Without matches that lie in the span of a match of another template with more matched
        words, or as many that cover more of it. Matches of one template do not overlap, so at
        most one of each is open at a place."""
        rank = lambda m: (m[3], m[3] / len(self.words[m[2]]), -m[2])
        kept, open_ = [], []
        for x in sorted(found, key=lambda m: (m[0], -m[1], *(-r for r in rank(m)))):
            open_ = [y for y in open_ if y[1] > x[0]]
            if not any(y[1] >= x[1] and y[2] != x[2] and rank(y) > rank(x) for y in open_):
                kept.append(x)
            open_.append(x)
        return sorted(kept)

    def scan(self, text: str | None, coverage: float) -> list[tuple[str, str, float, int, int, int, int]]:
        """Matches in the order of their place: license, kind, coverage, matched words, words of
        the template, and the span in characters."""
        words = WORD.findall(text.lower()) if text else []
        if len(words) < GRAM or not len(self.keys):
            return []
        found = self.matches(word_hashes(words), coverage)
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(text)] if len(text) == len(text.lower()) else _spans(text)
        return [(*self.names[t], m / len(self.words[t]), m, len(self.words[t]), spans[b][0], spans[e - 1][1]) for b, e, t, m in found]


def _spans(text: str) -> list[tuple[int, int]]:
    """Spans in the text of the words of its lower-case form, where lowering changes lengths."""
    owner = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(owner[m.start()], owner[m.end() - 1] + 1) for m in re.finditer(WORD, "".join(c.lower() for c in text))]


def scan(docs: DataFrame, given: Mapping[tuple[str, str], str] | None = None, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per match: ``doc_id``, ``license_id``, ``template``, ``coverage``,
    ``matched_words``, ``template_words``, ``start_char``, ``end_char`` (exclusive). ``given`` maps
    (license, kind) to the text of the template.

    Null, empty and short texts match nothing; templates under three words are not found;
    matches of one template do not overlap, the fullest is taken first; a match within the span
    of another template's fuller match is left out; repeated rows repeat their matches. Other
    columns are not read.
    """
    base = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    wanted = templates() if given is None else dict(given)
    names = ["doc_id", "license_id", "template", "coverage", "matched_words", "template_words", "start_char", "end_char"]
    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, license_id string, template string, coverage double, " + ", ".join(f"{n} bigint" for n in names[4:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(wanted)
        for b in bounded(batches):
            found = [(d.as_py(), *m) for d, t in zip(b.column("doc_id"), b.column("text").to_pylist(), strict=True) for m in index.scan(t, coverage)]
            if found:
                kinds = [b.schema.field("doc_id").type, pa.string(), pa.string(), pa.float64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names)

    return base.mapInArrow(run, schema)
