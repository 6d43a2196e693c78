"""License scans: winnowed template fingerprints in an inverted index pick candidates, banded alignment measures them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.alignment import banded
from loomtext.llm.common import pick, session

#: Words of a fingerprint, fingerprints of a winnowing window, half-width of the alignment band.
GRAM, WINDOW, BAND = 3, 2, 8
#: Templates of fewer words are winnowed by windows of one, and of still fewer by pairs of words: a fifth of their words may be broken, which
#: from 20 words on leaves four in a row, from 10 on three, and below that two.
UNWINNOWED, PAIRS = 20, 10
COVERAGE = 0.8
#: Of a template at `coverage` a fifth of the words may be broken; runs of four whole words hold a fingerprint each, so more than one
#: fingerprint in HITS words is left on the diagonals of a band.
HITS = 20
#: Words from which a template is a text and no notice, and from which so much is named in it that an edited copy may lack some of the names.
WHOLE, LONG = 25, 500
#: Bytes of templates that one folder may hold: they go to every task.
TEMPLATE_BYTES = 16 << 20

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details."


def _gnu(name: str, version: str, what: str = "program") -> str:
    return f"This {what} is free software: " + _GNU.format(name=name, v=version, what=what)


#: Whole texts of short licenses, and of long ones the notice that files bear.
TEMPLATES: dict[str, str] = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY,
    "BSD-2-Clause": _BSD_CLAUSES + _BSD_END,
    "BSD-3-Clause": _BSD_CLAUSES + _BSD_THIRD + _BSD_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-2.0-or-later": _gnu("", "2"),
    "GPL-3.0-or-later": _gnu("", "3"),
    "LGPL-2.1-or-later": _gnu("Lesser", "2.1", "library"),
    "LGPL-3.0-or-later": _gnu("Lesser", "3", "library"),
    "AGPL-3.0-or-later": _gnu("Affero", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-notice": "Licensed under the BSD License.",
    "ISC-notice": "Licensed under the ISC License.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    **{f"CC-{c}-notice": f"Licensed under CC {c} 4.0." for c in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    **{f"{i}-SPDX": f"SPDX-License-Identifier: {i}" for i in (
        "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later",
        "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "EPL-2.0", "CC0-1.0", "CC-BY-4.0",
    )},
}
#: Words that tell licenses apart: those of a template must all be matched in place, and none of the others may stand there instead.
NAMING = frozenset("mit apache gnu lesser affero mozilla eclipse bsd isc cc by sa nc nd zlib bsl unlicense creative sharealike noncommercial gpl lgpl agpl mpl epl spdx only cc0 0bsd 2 3 clause".split())
#: Before a notice these turn it round.
NEGATIONS = frozenset("not never isn wasn aren without neither".split())

_WORDS = re.compile(r"\w+")


def _keys(ids: np.ndarray, n: int) -> np.ndarray:
    x, out = ids.astype(np.uint64), np.zeros(max(0, len(ids) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + x[i : len(x) - n + 1 + i]
    return out


def winnow(keys: np.ndarray, window: int) -> list[int]:
    """Places of the selected fingerprints: the rightmost smallest of each window of neighbours."""
    picked: list[int] = []
    for lo in range(max(1, len(keys) - window + 1)):
        part = keys[lo : lo + window]
        at = lo + len(part) - 1 - int(np.argmin(part[::-1]))
        if not picked or picked[-1] != at:
            picked.append(at)
    return picked if len(keys) else []


class Index:
    """The inverted index over a fixed set of templates, small by nature; it goes to the tasks with the code."""

    def __init__(self, templates: dict[str, str]):
        self.number: dict[str, int] = {}
        self.texts, self.naming = {}, {}
        self.needed: dict[str, set[int]] = {}  # naming words of notices: without all of them in the text there is no such notice
        postings: dict[int, dict[int, list[tuple[str, int]]]] = {GRAM: {}, 2: {}}
        for name, text in templates.items():
            ws = _WORDS.findall(text.lower())
            if len(ws) < GRAM:
                raise ValueError(f"template {name} has fewer than {GRAM} words")
            for w in ws:
                self.number.setdefault(w, xxhash.xxh64_intdigest(w, 3) >> 1 | 1)
            self.texts[name] = np.array([self.number[w] for w in ws], np.uint64)
            self.naming[name] = Counter(w for w in ws if w in NAMING)
            self.needed[name] = {self.number[w] for w in self.naming[name]} if len(ws) < WHOLE else set()
            n = GRAM if len(ws) >= PAIRS else 2
            keys = _keys(self.texts[name], n)
            for at in winnow(keys, WINDOW if len(ws) >= UNWINNOWED else 1):
                postings[n].setdefault(int(keys[at]), []).append((name, at))
        self.postings = {n: p for n, p in postings.items() if p}
        self.sorted = {n: np.sort(np.array(list(p), np.uint64)) for n, p in self.postings.items()}

    def _names(self, name: str, words: list[str], a: int, b: int, coverage: float) -> bool:
        """Whether the words in place name this license and no other, and no negation stands before a short notice of it."""
        there = Counter(w for w in words[a:b] if w in NAMING)
        if len(self.texts[name]) >= LONG:  # its relatives' whole texts compete with it by score
            return (self.naming[name] - there).total() <= (1 - coverage) * self.naming[name].total()
        if there != self.naming[name] and (self.naming[name] - there or (there - self.naming[name] and len(self.texts[name]) < WHOLE)):
            return False
        return len(self.texts[name]) >= WHOLE or not NEGATIONS & set(words[max(0, a - 3) : a])

    def scan(self, text: str, coverage: float) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end) of each license found; code points, the end exclusive; of overlapping ones the best aligned."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in _WORDS.findall(text.lower())], np.uint64)
        if len(ids) < GRAM:
            return []
        known = np.flatnonzero(ids)
        here = set(ids[known].tolist())
        diagonals: dict[str, list[int]] = {}
        for n, postings in self.postings.items():
            at = known[: 1 - n][known[n - 1 :] - known[: 1 - n] == n - 1]  # n words of templates in a row
            if not len(at):
                continue
            keys = _keys(ids, n)[at]
            place = np.minimum(np.searchsorted(self.sorted[n], keys), len(self.sorted[n]) - 1)
            for h in np.flatnonzero(self.sorted[n][place] == keys).tolist():
                for name, pos in postings[int(keys[h])]:
                    if self.needed[name] <= here:
                        diagonals.setdefault(name, []).append(int(at[h]) - pos)
        found, words = [], None
        for name, ds in diagonals.items():
            item = self.texts[name]
            tried: list[int] = []
            ds.sort()
            need = max(1, len(item) // HITS)
            for d in sorted(set(ds)):
                if tried and d - tried[-1] <= BAND // 2:
                    continue
                if bisect_right(ds, d + BAND) - bisect_left(ds, d - BAND) < need:
                    continue
                tried.append(d)
                rest = [(max(0, d - BAND), min(len(ids), d + len(item) + BAND + 1))]
                while rest:  # beside a copy there may be another within the band
                    lo, hi = rest.pop()
                    if hi - lo < coverage * len(item):
                        continue
                    score, matched, start, end = banded(item, ids[lo:hi], d - lo, BAND)
                    if matched and matched >= coverage * len(item):
                        words = words or _WORDS.findall(text.lower())
                        if self._names(name, words, lo + start, lo + end, coverage):
                            found.append((score, name, matched / len(item), matched, lo + start, lo + end))
                        rest += [(lo, lo + start), (lo + end, hi)]
        if not found:
            return []
        found.sort(key=lambda f: (-f[0], f[4], f[1]))
        kept: list[tuple] = []
        for f in found:
            if not any(f[4] < g[5] and g[4] < f[5] for g in kept):
                kept.append(f)
        places = [m.span() for m in _WORDS.finditer(text)]
        if len(places) != len(ids):  # lower-casing has changed the words' number: find them in the changed text
            places = [m.span() for m in _WORDS.finditer(text.lower())]
        return sorted((name, cover, matched, places[a][0], places[b - 1][1]) for _, name, cover, matched, a, b in kept)


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """The built-in templates and the whole license texts of a folder, each file a template named like it (without .txt).

    A file replaces the built-in template of its name. Files of fewer than three words are left out; a folder of more than
    TEMPLATE_BYTES is refused, as templates are sent to every task.
    """
    files = spark.read.text(folder, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("name"), "value")
    held = files.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if held > TEMPLATE_BYTES:
        raise ValueError(f"{folder} holds {held} bytes of templates, more than {TEMPLATE_BYTES}")
    return TEMPLATES | {name: text for name, text in sorted(map(tuple, files.collect())) if len(_WORDS.findall(text)) >= GRAM}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, matched_words, start, end): one row for each license passage found in a whole text.

    A template is a candidate where its winnowed fingerprints occur; it is reported if aligned words make up `coverage` of it, and the
    words that tell licenses apart are those of the template. Of passages that overlap the best aligned one counts, of equal ones the
    first, then the first by name. Null and empty texts have none; very long texts are scanned whole, in time proportional to them and
    the candidates; repeated rows are reported each; an empty table gives an empty result; other columns may have any names.
    """
    session(docs)
    index = Index(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, *f) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if t for f in index.scan(t, coverage)]
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "license", "coverage", "matched_words", "start", "end"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, matched_words long, start long, end long")
