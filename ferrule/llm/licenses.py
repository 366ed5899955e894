"""License scans by patience alignment with license texts.

A text and a template are aligned on the words that are unique in both: the longest
increasing subsequence of their places holds, the gaps between its members are aligned the
same way, and equal words next to what is aligned join it.  Coverage is the aligned share
of the template's words, or of the words they span in the text where those are more.  As a
license that stands twice in a text has no unique words there, windows of a text are aligned.  So many of the template's words, rarest
in the text first, that no copy with enough coverage can lack them all propose a window
at each of their places; windows overlap, coverage decides, and of overlapping hits the best one counts.

Defined results: null, empty and wordless texts have no license; texts are read whole;
equal texts get equal results; of equal coverages the template named first in order of
its id is the best; no template at all finds nothing; extra columns are left out unless
kept by name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, table

#: Share of a template's words that must be aligned, and for templates of up to SHORT words.
COVERAGE, SHORT_COVERAGE, SHORT = 0.8, 0.9, 16

_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")

# The wording of public licenses and of their usual notices.
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": _BSD_START + _BSD_THIRD + _BSD_END,
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-3-Clause-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright
holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MIT-line": "Released under the MIT License",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0",
}


def words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)] if text else []


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience piles with back links)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = piles[p - 1] if p else -1
        tops[p : p + 1] = [v]
        piles[p : p + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str], whole: bool = True) -> list[tuple[int, int]]:
    """Aligned places of two word lists, in order; unless ``whole``, b may begin before a and end behind it."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), whole, whole)]
    while todo:
        a_lo, a_hi, b_lo, b_hi, from_left, from_right = todo.pop()
        while from_left and a_lo < a_hi and b_lo < b_hi and a[a_lo] == b[b_lo]:
            out.append((a_lo, b_lo))
            a_lo, b_lo = a_lo + 1, b_lo + 1
        while from_right and a_lo < a_hi and b_lo < b_hi and a[a_hi - 1] == b[b_hi - 1]:
            a_hi, b_hi = a_hi - 1, b_hi - 1
            out.append((a_hi, b_hi))
        if a_lo >= a_hi or b_lo >= b_hi:
            continue
        in_a, in_b = _unique(a, a_lo, a_hi), _unique(b, b_lo, b_hi)
        pairs = [(i, in_b[w]) for w, i in in_a.items() if i >= 0 and in_b.get(w, -1) >= 0]
        pairs.sort()
        kept = [pairs[k] for k in longest_increasing([j for _, j in pairs])]
        if not kept:
            continue
        out += kept
        edges = [(a_lo - 1, b_lo - 1), *kept, (a_hi, b_hi)]
        last = len(edges) - 2
        todo += [(i + 1, i2, j + 1, j2, from_left or k > 0, from_right or k < last) for k, ((i, j), (i2, j2)) in enumerate(zip(edges, edges[1:], strict=False))]
    return sorted(out)


def _unique(found: list[str], lo: int, hi: int) -> dict[str, int]:
    places: dict[str, int] = {}
    for i in range(lo, hi):
        places[found[i]] = -1 if found[i] in places else i
    return places


def proposed(places: dict[str, list[int]], template: list[str], need: int) -> set[int]:
    """Where the template's first word would stand, by every place of words of which a copy with ``need`` words holds one at least."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(template):
        at.setdefault(w, []).append(i)
    out: set[int] = set()
    left = len(template) - need + 1
    for w in sorted(at, key=lambda w: (len(places.get(w, ())), at[w][0])):
        if left <= 0:
            break
        out.update(p - i for p in places.get(w, ()) for i in at[w])
        left -= len(at[w])
    return out


def covered(pairs: list[tuple[int, int]], size: int, need: int) -> tuple[float, int, int]:
    """(coverage, first, last place): aligned words as a share of the template, or of the stretch they span if that is longer; strays at its ends are left out."""
    best = (0.0, 0, -1)
    for i in range(len(pairs) - need + 1):
        for j in range(len(pairs) - 1, i + need - 2, -1):
            span = pairs[j][1] - pairs[i][1] + 1
            best = max(best, ((j - i + 1) / max(size, span), pairs[i][1], pairs[j][1]), key=lambda x: x[0])
            if span <= size:
                break
    return best


def hits(found: list[str], places: dict[str, list[int]], template: list[str], enough: float) -> list[float]:
    """The coverage of each copy of the template that covers enough, the best first; copies do not overlap."""
    size, n = len(template), len(found)
    need = max(1, math.ceil(enough * size - 1e-9))
    # words put in or left out move a word of a copy by so much at most
    margin = min(n, math.ceil(size / enough - size)) if enough > 0 else n
    step = max(1, size // 8)
    starts = proposed(places, template, need)
    if not starts:
        return []
    known = dict.fromkeys(template)
    shared = [0, *accumulate(w in known for w in found)]
    asked = Counter(template)

    def could_cover(lo, hi):
        return shared[hi] - shared[lo] >= need and (asked & Counter(found[lo:hi])).total() >= need

    windows = {(max(0, d), min(n, d + size), True) for d in starts if d < n and d + size > 0}
    windows |= {(max(0, d - margin), min(n, d + step + size + margin), False) for d in {d - d % step for d in starts}}
    good = []
    for lo, hi, whole in windows:
        if could_cover(lo, hi):
            share, first, last = covered(align(template, found[lo:hi], whole), size, need)
            if share >= enough and last >= first:
                good.append((-share, lo + first, lo + last))
    out: list[float] = []
    taken: list[tuple[int, int]] = []
    for share, first, last in sorted(set(good)):
        k = bisect_left(taken, (first, -1))
        if (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or taken[k][0] > last):
            taken.insert(k, (first, last))
            out.append(-share)
    return out


def find_licenses(text: str | None, templates: dict[str, list[str]], coverage: float = COVERAGE) -> list[tuple[str, float, int]]:
    """(template id, coverage, number of copies) of each template that covers enough, in order of id."""
    found = words(text)
    places: dict[str, list[int]] = {}
    for i, w in enumerate(found):
        places.setdefault(w, []).append(i)
    out = []
    for name in sorted(templates):
        template = templates[name]
        enough = max(coverage, SHORT_COVERAGE) if len(template) <= SHORT else coverage
        if sum(w in places for w in template) < enough * len(template):
            continue
        good = hits(found, places, template, enough)
        if good:
            out.append((name, good[0], len(good)))
    return out


def scan(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, keep: list[str] | None = None) -> DataFrame:
    """Adds n_licenses, licenses (ids, comma-joined), best and best_coverage."""
    parsed = {k: words(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    parsed = {k: v for k, v in parsed.items() if v}

    def make(texts):
        made: dict[str, list] = {"n_licenses": [], "licenses": [], "best": [], "best_coverage": []}
        for text in texts:
            found = find_licenses(text, parsed, coverage)
            best = max(found, key=lambda f: f[1]) if found else (None, 0.0, 0)
            made["n_licenses"].append(len(found))
            made["licenses"].append(",".join(f[0] for f in found))
            made["best"].append(best[0])
            made["best_coverage"].append(best[1])
        return made

    added = [("n_licenses", T.LongType()), ("licenses", T.StringType()), ("best", T.StringType()), ("best_coverage", T.DoubleType())]
    return map_texts(documents, "text", make, added, keep)


def op9_licenses(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
