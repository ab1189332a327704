"""License scans by patience alignment of whole texts with license templates.

A template can only be covered where enough of its words stand close together. Text words that occur in the template
are found by hash; every window of `SPREAD` times the template's words that holds at least the threshold's share of
them, repeats counted as in the template, is aligned: words that occur once in both sides anchor the alignment, their
longest increasing subsequence is kept, and the gaps between anchors are aligned again, after matching their ends word
by word. Coverage is the share of the template's words that the best window's alignment matches. The counts bound the
coverage of a window from above, so no window that could reach the threshold is passed over.

Every template has a coverage of its own from which it counts as a license: `THRESHOLD` for headers and license texts, 1
for the one-line notices and tags of `EXACT`, whose siblings can differ in one word. A template covered to the threshold
but not to its own share, such as a notice with one word changed, is reported as near with its coverage, and so are the
siblings of a notice that is there in full. License texts stand beside their opening parts, so a text that stops before
the disclaimer is known as well.

Defined results: words as elsewhere here (ASCII letters and digits, non-ASCII characters, in lower case); null, empty
and wordless texts match nothing; several templates can match one text; the best has the greatest coverage, then the
most matched words, then the first name; equal texts give equal results, repeated rows repeated ones; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, column, pieces, small_batches, table
from .words import split

#: Least coverage, and words of a window for each word of the template.
THRESHOLD, SPREAD = 0.8, 1.5

#: Disclaimers that follow the grants below (fixed values).
MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
UNLICENSE_END = """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law."""
#: Public license notices (fixed values).
TEMPLATES = {
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more
details.""",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide. This software is distributed without any warranty.""",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details.""",
    "LGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details.""",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
}
#: Whole license texts: what stands above is their opening part.
TEMPLATES |= {"MIT text": TEMPLATES["MIT"] + " " + MIT_END, "ISC text": TEMPLATES["ISC"] + " " + ISC_END, "Unlicense text": TEMPLATES["Unlicense"] + " " + UNLICENSE_END + " " + MIT_END}
TEMPLATES |= {f"{x} text": TEMPLATES[x] + " " + BSD_END for x in ("BSD-2-Clause", "BSD-3-Clause")}
#: Names that SPDX tags can give; a tag is a template like the others.
SPDX = """AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0-only
GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense""".split()
TEMPLATES |= {f"SPDX {x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
#: Templates that count only when covered in full: a word tells them from their siblings.
EXACT = """AGPL-3.0 notice, Apache-2.0 notice, CC-BY-4.0 notice, CC-BY-NC-4.0 notice, CC-BY-SA-4.0 notice, GPL-2.0 notice, GPL-3.0 notice,
LGPL-3.0 notice, MIT notice""".replace("\n", " ").split(", ") + [f"SPDX {x}" for x in SPDX]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (patience sorting with back links)."""
    tops, places, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(places[k - 1] if k else -1)
        tops[k : k + 1], places[k : k + 1] = [v], [i]
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places with equal words, increasing on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        where = {w: y for y, w in enumerate(b[j:n], j) if cb[w] == 1}
        unique = [(x, where[w]) for x, w in enumerate(a[i:m], i) if ca[w] == 1 and w in where]
        anchors = [unique[k] for k in increasing([y for _, y in unique])]
        if not anchors:
            continue
        out += anchors
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)]):
            todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, threshold: float, own: float) -> None:
        data, offs = as_bytes(pa.array([text]))
        self.name, self.words = name, split(data, offs).hashes.tolist()
        self.counts = Counter(self.words)
        self.vocabulary = np.unique(np.array(self.words, np.uint64))
        self.near, self.least = (int(np.ceil(x * len(self.words) - 1e-9)) for x in (threshold, own))  # words to be reported, and to count
        self.width = int(np.ceil(SPREAD * len(self.words)))


def candidates(template: Template, hits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First words of all windows with enough words of the template; a window starts with one and stays in its text."""
    if len(hits) < template.near:
        return hits[:0]
    stop = np.minimum(hits + template.width, first[np.searchsorted(first, hits, "right")])
    return hits[np.searchsorted(hits, stop) - np.arange(len(hits)) >= template.near]


def best_alignment(template: Template, words: np.ndarray, starts: list[int], end: int) -> tuple[int, int, int]:
    """(matched words, first, last) of the candidate window of one text that covers most; the first of equal ones."""
    best = 0, 0, 0
    for a in starts:
        own = words[a : min(a + template.width, end)].tolist()
        if (Counter(own) & template.counts).total() < max(template.near, best[0] + 1):
            continue
        pairs = align(own, template.words)
        if len(pairs) > best[0]:
            best = len(pairs), a + pairs[0][0], a + pairs[-1][0]
            if best[0] == len(template.words):
                break
    return best


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple = (), templates: dict[str, str] | None = None, threshold: float = THRESHOLD, own: dict[str, float] | None = None) -> DataFrame:
    """The `keep` columns and license (best or null), coverage, n_matched, start and stop of the match in code points,
    and licenses (all names, sorted, joined by `|`); then near_license, near_coverage, near_start and near_stop of the
    best template that reaches the threshold but not its own share, and near (all of these, best first, each with a colon
    and its coverage to six digits, joined by `|`). `own` gives templates' own shares, by default 1 for those of `EXACT`
    and the threshold for all others."""
    small_batches(docs.sparkSession)
    own = dict.fromkeys(EXACT, 1.0) if own is None else own
    known = [Template(k, v, threshold, max(threshold, own.get(k, threshold))) for k, v in sorted((templates or TEMPLATES).items())]
    known = [t for t in known if t.words]
    every = np.unique(np.concatenate([t.vocabulary for t in known]))
    has = np.stack([np.isin(every, t.vocabulary) for t in known])
    seen = np.zeros(1 << 20, bool)
    seen[every >> np.uint64(44)] = True
    shared = docs.sparkSession.sparkContext.broadcast((known, every, has, seen))
    carried = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, carried, strict=True)), F.col(text_col).alias("t"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches):
        known, every, has, seen = shared.value
        for batch, data, offs in pieces(batches, "t"):
            w = split(data, offs)
            spot = np.flatnonzero(seen[w.hashes >> np.uint64(44)])
            near = np.minimum(np.searchsorted(every, w.hashes[spot]), len(every) - 1)
            ok = every[near] == w.hashes[spot]
            spot, near = spot[ok], near[ok]
            found: dict[int, list] = {}
            close: dict[int, list] = {}
            for k, template in enumerate(known):
                starts = candidates(template, spot[has[k][near]], w.first)
                text = np.searchsorted(w.first, starts, "right") - 1
                for i in np.unique(text).tolist():
                    n, x, y = best_alignment(template, w.hashes, starts[text == i].tolist(), int(w.first[i + 1]))
                    if n >= template.near:
                        (found if n >= template.least else close).setdefault(i, []).append((-n / len(template.words), -n, template.name, x, y))
            rows = []
            for i in range(batch.num_rows):
                row = [None, 0.0, 0, None, None, "", None, 0.0, None, None, ""]
                if i in found or i in close:
                    raw = data[offs[i] : offs[i + 1]].tobytes()
                    place = lambda b: len(raw[: b - offs[i]].decode())  # noqa: E731, B023
                if i in found:
                    share, n, name, x, y = min(found[i])
                    row[:6] = name, -share, -n, place(w.starts[x]), place(w.ends[y]), "|".join(sorted(f[2] for f in found[i]))
                if i in close:
                    share, _, name, x, y = min(close[i])
                    row[6:] = name, -share, place(w.starts[x]), place(w.ends[y]), "|".join(f"{f[2]}:{-f[0]:.6f}" for f in sorted(close[i]))
                rows.append(row)
            types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            names = ["license", "coverage", "n_matched", "start", "stop", "licenses", "near_license", "near_coverage", "near_start", "near_stop", "near"]
            yield pa.RecordBatch.from_arrays([column(batch, k) for k in carried] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*carried, *names])

    out = source.mapInArrow(run, kinds + "license string, coverage double, n_matched long, start long, stop long, licenses string, near_license string, near_coverage double, near_start long, near_stop long, near string")
    return out.withColumnsRenamed(dict(zip(carried, keep, strict=True)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all templates."""
    return scan_licenses(table(spark, sf_dir, "documents"), keep=("doc_id",))
