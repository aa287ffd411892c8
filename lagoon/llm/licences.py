"""Licence scan: parts of a text against licence templates, by the Dice coefficient of word bigrams.

A candidate is a run of words, wherever it begins and ends, so a notice within a
sentence, one of a line and a licence of many paragraphs are found alike. Dice =
2 * shared / (a + b) can only reach the limit if a lies between limit / (2 - limit)
and (2 - limit) / limit times b: these size bounds leave few ends for a start. An
end bigram that the template lacks only lowers the coefficient, so the best runs begin and
end with bigrams of the template, which are the seeds; and a run that reaches the limit
shares at least limit / (2 - limit) of the template's bigrams, so a text that nowhere holds
so many of any template, as nearly all, is done after one look at its bigrams.

Templates of two licences that are so alike that a text of one would do for the other are
told apart by their marks, the bigrams that only one of them has: a run is that licence's only
if it holds a mark against each such relative. A notice of a version that no template has is
therefore not named after its neighbour.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import arrow_map, slices

LIMIT = 0.8
#: Licence texts and notices.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
    OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
    LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
    CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
    use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
    Software is furnished to do so"""
_MIT_TERMS = """, subject to the following conditions: The above copyright notice and this permission notice shall be included in
    all copies or substantial portions of the Software."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
    and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
    conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission. """
_BSD_AS_IS = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
    NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
    OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
    NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TERMS = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
    CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
    NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(name: str, version: str) -> tuple[str, str]:
    """The line and the notice of a licence of the GNU family."""
    return (
        f"This work is licensed under the GNU {name}, version {version}.",
        f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
        the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.""",
    )


def _cc(code: str, words: str) -> tuple[str, str]:
    """The short and the long line of a Creative Commons licence."""
    return f"Licensed under CC {code} 4.0.", f"This work is licensed under a Creative Commons {words} 4.0 International License."


TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": (_ISC_GRANT + "." + _ISC_AS_IS,),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD_GRANT, _BSD_GRANT + _BSD_AS_IS),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _BSD_GRANT + _BSD_NAMES,
        _BSD_GRANT + _BSD_NAMES + _BSD_AS_IS,
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    "ISC": ("Licensed under the ISC License.", _ISC_GRANT + _ISC_TERMS, _ISC_GRANT + _ISC_TERMS + _ISC_AS_IS),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "MIT": ("Released under the MIT License.", _MIT_GRANT + _MIT_TERMS, _MIT_GRANT + _MIT_TERMS + " " + _AS_IS),
    "MIT-0": (_MIT_GRANT + ". " + _AS_IS,),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means.""",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
        may not be removed or altered from any source distribution.""",
    ),
}
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
#: Spellings that are the same word.
_SAME = {"license": "licence", "licensed": "licenced", "licenses": "licences", "copyrights": "copyright", "&": "and"}


def words_of(text: str) -> list[str]:
    """Normalised words: lower case, no marks around them, one spelling."""
    return [_SAME.get(w, w) for w in _WORD.findall(text.lower())]


def dice(a: Counter, b: Counter) -> float:
    """Twice the shared bigrams over all of both, repeats counted."""
    return 2 * sum(min(n, b[x]) for x, n in a.items() if x in b) / max(1, a.total() + b.total())


Bigram = tuple[str, str]
Match = tuple[str, float, int, int]


class Scanner:
    def __init__(self, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, limit: float = LIMIT):
        self.limit, self.share = limit, limit / (2 - limit)
        bags = []
        for name, texts in templates.items():
            for n, t in enumerate(texts):
                w = words_of(t)
                bags.append((Counter(zip(w, w[1:], strict=False)), name, n))
        self.bags = sorted((b for b in bags if b[0]), key=lambda x: (x[0].total(), x[1], x[2]))
        self.sizes = [b[0].total() for b in self.bags]
        #: For each template, its marks against each relative that lacks any of its bigrams.
        self.marks: list[list[frozenset[Bigram]]] = []
        for bag, name, _ in self.bags:
            relatives = [other for other, whose, _ in self.bags if whose != name and dice(bag, other) >= limit]
            self.marks.append([m for m in (frozenset(bag.keys() - r.keys()) for r in relatives) if m])
        self.where: dict[Bigram, list[tuple[int, int]]] = {}
        for k, (bag, _, _) in enumerate(self.bags):
            for x, n in bag.items():
                self.where.setdefault(x, []).append((k, n))

    def templates_in(self, pairs: list[Bigram]) -> list[int]:
        """Templates of which the text holds enough bigrams, anywhere, for a run to reach the limit."""
        reach: dict[int, int] = {}
        for x in self.where.keys() & set(pairs):
            for k, n in self.where[x]:
                reach[k] = reach.get(k, 0) + n
        return sorted(k for k, n in reach.items() if n >= self.share * self.sizes[k] - 1e-9)

    def _runs(self, k: int, pairs: list[Bigram]) -> list[tuple[float, int, int]]:
        """(dice, first bigram, last bigram) of the best run from each start that reaches the limit with template k; of equal ones the shortest."""
        bag, size, marks = self.bags[k][0], self.sizes[k], self.marks[k]
        seeds = [p for p, x in enumerate(pairs) if x in bag]
        most, least = int(size / self.share + 1e-9), self.share * size - 1e-9
        out = []
        for n, first in enumerate(seeds):
            if bisect_left(seeds, first + most) - n < least:
                continue
            left, shared, best = dict(bag), 0, None
            missing = marks
            for last in seeds[n:]:
                if last - first >= most:
                    break
                x = pairs[last]
                if left[x]:
                    left[x] -= 1
                    shared += 1
                missing = [m for m in missing if x not in m]
                d = 2 * shared / (last - first + 1 + size)
                if d >= self.limit - 1e-9 and not missing and (best is None or d > best[0] + 1e-12):
                    best = (d, first, last)
            if best:
                out.append(best)
        return out

    def scan(self, text: str) -> list[Match]:
        """(licence, dice, first word, last word) of the best runs that do not overlap, by place."""
        words = words_of(text)
        pairs = list(zip(words, words[1:], strict=False))
        runs = [(d, a, b + 1, k) for k in self.templates_in(pairs) for d, a, b in self._runs(k, pairs)]
        out: list[Match] = []
        taken = bytearray(len(words))
        for d, a, b, k in sorted(runs, key=lambda r: (-r[0], r[1] - r[2], r[1], r[3])):
            if not (taken[a] or taken[b] or any(taken[a : b + 1])):
                taken[a : b + 1] = b"\1" * (b + 1 - a)
                out.append((self.bags[k][1], d, a, b))
        return sorted(out, key=lambda x: x[2])


def scan_licences(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, limit: float = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, licence, dice, n_matches, matches) of every row.

    licence, dice: the best match (of equal ones the first in the text), null
    without any. matches: all of them, as licence:dice:first word:last word. Each
    template has one run from each start, its best; of all runs those of the highest
    coefficient are taken first, of equal ones the longest, then the first, then the
    smaller template, then the first by name; what overlaps a taken run is not one. Null and
    empty texts have none. A text costs its words times the size of the templates it holds
    much of. Templates are configuration, sent to all tasks.
    """
    templates = dict(templates)

    def work(batch):
        scanner = Scanner(templates, limit)
        for part in slices(batch, "t"):
            found = [scanner.scan(t or "") for t in part.column("t").to_pylist()]
            best = [max(x, key=lambda m: (m[1], -m[2])) if x else (None, None) for x in found]
            yield {
                "doc_id": part.column("i"), "licence": [b[0] for b in best], "dice": [b[1] for b in best], "n_matches": [len(x) for x in found],
                "matches": [",".join(f"{n}:{d:.6f}:{i}:{j}" for n, d, i, j in x) for x in found],
            }

    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t"))
    return arrow_map(rows, work, "doc_id long, licence string, dice double, n_matches long, matches string")
