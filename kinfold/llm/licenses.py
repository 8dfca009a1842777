"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are winnowed (Schleimer et al., 2003) into an inverted index fingerprint -> (template,
place). Each text is winnowed the same way where it lies; a shared fingerprint names a template and a
diagonal. Every such diagonal whose band holds enough of the template's words at all is aligned with the template in
that band, and is a match if at least `threshold` of the template's words match.

Texts that share `gram + window - 1` consecutive words always share a fingerprint. With the defaults that is 3 words,
and whoever keeps 80 % of 6 words or more in order has 3 in a row. The templates are
a parameter of bounded size (`index_bytes` is checked) that goes along with the function; no row
is shuffled. Words are runs of letters and digits, ASCII lower-cased; places count words.

The match with the most matched words (then the highest coverage, name, place) is taken first; others are aligned
again without its words. So neighbouring statements are each found, and of the versions of a license the better match.

Results: one row per match, so a text without any gives none; a license stated twice gives two rows. Null
and empty texts give none. Equal rows give equal matches each. Null ids are kept. Very long texts are scanned whole.
Only the id and text columns are read; the templates cover the licenses of TEMPLATES, no others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.anchors import Rolling, word_symbols
from kinfold.session import ship

#: License texts and the customary notices and statements of longer licenses, by SPDX name. Fixed values.
TEMPLATES = {
    "Apache-2.0-statement": 'Licensed under the Apache License, Version 2.0.',
    "MIT-statement": 'Released under the MIT License.',
    "GPL-2.0-statement": 'This work is licensed under the GNU General Public License, version 2.',
    "GPL-3.0-statement": 'This work is licensed under the GNU General Public License, version 3.',
    "LGPL-2.1-statement": 'This work is licensed under the GNU Lesser General Public License, version 2.1.',
    "LGPL-3.0-statement": 'This work is licensed under the GNU Lesser General Public License, version 3.',
    "AGPL-3.0-statement": 'This work is licensed under the GNU Affero General Public License, version 3.',
    "CC-BY-4.0-statement": 'Licensed under CC BY 4.0.',
    "CC-BY-SA-4.0-statement": 'Licensed under CC BY-SA 4.0.',
    "CC-BY-NC-4.0-statement": 'Licensed under CC BY-NC 4.0.',
    "CC-BY-ND-4.0-statement": 'Licensed under CC BY-ND 4.0.',
    "CC-BY-4.0": (
        'This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit '
        'http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.'
    ),
    "CC-BY-SA-4.0": (
        'This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, '
        'visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, '
        'USA.'
    ),
    "CC0-1.0": (
        'To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software '
        'to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 '
        'Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.'
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to '
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        'KIND, either express or implied. See the License for the specific language governing permissions and limitations under the '
        'License.'
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        'merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is '
        'furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included '
        'in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        'IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN '
        'NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF '
        'CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided '
        'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        'DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT '
        'SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM '
        'LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN '
        'CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
        'conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the '
        'following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the '
        'following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE '
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        'WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR '
        'CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT '
        'LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED '
        'AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY '
        'WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    ),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
        'conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the '
        'following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the '
        'following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the '
        'copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without '
        'specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
        'IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE '
        'ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, '
        'EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, '
        'DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, '
        'OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY '
        'OF SUCH DAMAGE.'
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        'damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including '
        'commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this '
        'software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a '
        'product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must '
        'be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or '
        'altered from any source distribution.'
    ),
    "BSL-1.0": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying '
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
        'and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all '
        'subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this '
        'restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative '
        'works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated '
        'by a source language processor.'
    ),
    "Unlicense": (
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, '
        'sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non- '
        'commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any '
        'and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large '
        'and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of '
        'all present and future rights to this software under copyright law.'
    ),
    "GPL-2.0": (
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as '
        'published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is '
        'distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or '
        'FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU '
        'General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth '
        'Floor, Boston, MA 02110-1301 USA.'
    ),
    "GPL-3.0": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as '
        'published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is '
        'distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or '
        'FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU '
        'General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'
    ),
    "LGPL-2.1": (
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License '
        'as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This '
        'library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of '
        'MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have '
        'received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, '
        'Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.'
    ),
    "LGPL-3.0": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License '
        'as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program '
        'is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY '
        'or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy '
        'of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'
    ),
    "AGPL-3.0": (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License '
        'as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program '
        'is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY '
        'or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy '
        'of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'
    ),
    "MPL-2.0": (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with '
        'this file, You can obtain one at https://mozilla.org/MPL/2.0/.'
    ),
    "EPL-2.0": (
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is '
        'available at https://www.eclipse.org/legal/epl-2.0/'
    ),
}

#: ASCII letters lower-cased, digits and bytes above 127 as they are, all else a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)


def words(raw: bytes) -> np.ndarray:
    """A hash for each word."""
    return word_symbols(_FOLD[np.frombuffer(raw, np.uint8)])[0]


def winnow(codes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, places): the rightmost smallest gram hash of each window of grams."""
    if len(codes) < gram:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = Rolling(codes).grams(gram)
    w = min(window, len(h))
    n = len(h) - w + 1
    best, place = h[w - 1 :].copy(), np.arange(w - 1, w - 1 + n)
    for k in range(w - 2, -1, -1):
        less = h[k : k + n] < best
        best[less], place[less] = h[k : k + n][less], np.arange(k, k + n)[less]
    place = np.unique(place)
    return h[place], place


def align(doc: np.ndarray, template: np.ndarray, shift: int, band: int, low: int, high: int) -> tuple[int, int, int]:
    """(matched, begin, end): most template words matched in order by doc words of [low, high) within `band` of the diagonal; of equals the first."""
    m, wide = len(template), 2 * band + 1
    first = max(low, shift - band)
    seen = doc[first : max(first, min(high, shift + m + band))].tolist()
    # for each place of the template: column -> (matched, -begin of the match, -end)
    none = (0, 0, 0)
    last = [none] * (wide + 1)
    for i, word in enumerate(template.tolist()):
        now = [none] * (wide + 1)
        left = none
        at = i + shift - band - first
        for j in range(max(0, -at), min(wide, len(seen) - at)):
            cell = max(last[j + 1], left)  # skip this template word, or this doc word
            if seen[at + j] == word:
                k, begin, _ = last[j]
                p = at + j + first
                cell = max(cell, (k + 1, begin if k else -p, -(p + 1)))
            now[j] = left = cell
        for j in range(max(0, min(wide, len(seen) - at)), wide):  # beyond the text only template words are skipped
            now[j] = left = max(last[j + 1], left)
        last = now
    k, begin, end = max(last)
    return k, -begin, -end


class Index:
    """Winnowed templates: fingerprint -> (template, place)."""

    def __init__(self, templates: dict[str, str], gram: int, window: int, index_bytes: int):
        if (size := sum(len(t.encode()) for t in templates.values())) > index_bytes:
            raise ValueError(f"templates of {size} bytes; the bound is {index_bytes}")
        self.names = sorted(templates)
        self.codes = [words(templates[n].encode()) for n in self.names]
        spots = sorted((int(h), t, int(p)) for t, codes in enumerate(self.codes) for h, p in zip(*winnow(codes, gram, window), strict=True))
        self.known, first = np.unique(np.array([x[0] for x in spots], np.uint64), return_index=True)
        self.bounds = np.append(first, len(spots))
        self.template, self.place = (np.array([x[i] for x in spots], np.int64) for i in (1, 2))
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.codes]))
        # for each template which words it has; the last column stands for all other words
        self.has = np.zeros((len(self.codes), len(self.vocabulary) + 1), bool)
        for t, codes in enumerate(self.codes):
            self.has[t, np.searchsorted(self.vocabulary, codes)] = True

    def diagonals(self, codes: np.ndarray, gram: int, window: int, band: int, threshold: float) -> list[tuple[int, int]]:
        """(template, doc place - template place) of shared fingerprints, where the band has enough words of the template at all."""
        h, places = winnow(codes, gram, window)
        if not len(h) or not len(self.known):
            return []
        spot = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hits = np.flatnonzero(self.known[spot] == h)
        if not len(hits):
            return []
        begin, n = self.bounds[spot[hits]], np.diff(self.bounds)[spot[hits]]
        at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = np.unique(np.stack([self.template[at], np.repeat(places[hits], n) - self.place[at]]), axis=1)
        word = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        word = np.where(self.vocabulary[word] == codes, word, len(self.vocabulary))
        out = []
        for t in np.unique(found[0]).tolist():
            shift, m = found[1][found[0] == t], len(self.codes[t])
            upto = np.concatenate([[0], np.cumsum(self.has[t, word])])
            inside = upto[np.clip(shift + m + band, 0, len(codes))] - upto[np.clip(shift - band, 0, len(codes))]
            out += [(t, s) for s in shift[inside >= threshold * m].tolist()]
        return out

    def scan(self, raw: bytes, gram: int, window: int, band: int, threshold: float) -> list[tuple[str, float, int, int, int, int]]:
        """(license, coverage, matched, length, begin, end) of each match, the best of all first; the others get by without its words."""
        codes = words(raw)
        queue: list[tuple] = []
        taken: list[tuple[int, int]] = []  # sorted

        def offer(t: int, s: int, low: int, high: int) -> None:
            template = self.codes[t]
            if min(high, s + len(template) + band) - max(low, s - band) >= threshold * len(template):
                k, begin, end = align(codes, template, s, band, low, high)
                if k and k >= threshold * len(template):
                    heappush(queue, (-k, -k / len(template), self.names[t], begin, end, t, s))

        for t, s in self.diagonals(codes, gram, window, band, threshold):
            offer(t, s, 0, len(codes))
        out = []
        while queue:
            k, share, name, begin, end, t, s = heappop(queue)
            i = bisect_left(taken, (begin, begin))
            before, after = taken[i - 1][1] if i else 0, taken[i][0] if i < len(taken) else len(codes)
            if before <= begin and end <= after:
                taken.insert(i, (begin, end))
                out.append((name, -share, -k, len(self.codes[t]), begin, end))
                continue
            # some of these words went to a better match: align with what is free in the band
            low, high = s - band, s + len(self.codes[t]) + band
            i, j = max(0, bisect_left(taken, (low, low)) - 1), bisect_left(taken, (high, high))
            edges = [0 if i == 0 else taken[i - 1][1], *(x for y in taken[i:j] for x in y), len(codes) if j == len(taken) else taken[j][0]]
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                offer(t, s, a, b)
        return sorted(out, key=lambda x: x[4])


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, *, id: str = "doc_id", text: str = "text", gram: int = 2, window: int = 2,
    band: int = 8, threshold: float = 0.8, index_bytes: int = 8 << 20,
) -> DataFrame:
    """id, license, coverage, n_matched, n_template, begin, end for each match."""
    ship(docs.sparkSession)
    index = Index(TEMPLATES if templates is None else templates, gram, window, index_bytes)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, who = [], []
            for i, t in enumerate(pc.cast(b.column(1), pa.binary())):
                found = index.scan(t.as_py(), gram, window, band, threshold) if t.is_valid else []
                rows += found
                who += [i] * len(found)
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id, "license", "coverage", "n_matched", "n_template", "begin", "end"])

    return docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(run, f"`{id}` {kind}, license string, coverage double, n_matched long, n_template long, begin long, end long")
