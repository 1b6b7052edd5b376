"""License scans by conditional compression.

Candidate windows are the words around each licensing cue, as far as the longest
template can reach from it however its lines are wrapped; windows that meet are one.
A window is compressed by itself and with each template as zstandard's raw dictionary, and the templates are
ranked by how many bytes they save. In this order they are compared with the window word by word; the
first one of which the window holds the words in order, up to ``1 - least`` of them, is confirmed and its words are taken
out. What is left is ranked again until nothing is confirmed, so no notice is lost to a longer or more similar one. Templates
whose words are not all but as many in the window cannot be confirmed and are not tried. Where windows overlap, the
notice that saves more stays. The differing words are reported.

Null and empty texts, and texts without a cue, give no row. Repeated rows of
documents are reported once each. An empty table gives no row. A text is cut into windows of a bounded size, so the time
for it grows with its length only; its words are held in memory. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._common import chunks, doc_text, table

LEAST = 0.85
#: Words that a window of dense cues holds before the next one begins; windows overlap by the reach of the longest template.
WINDOW_WORDS = 600

# fixed values: identifiers and names of licences, and wordings of notices
NAMES = {
    "0BSD": "BSD Zero Clause License", "AFL-3.0": "Academic Free License version 3.0", "AGPL-3.0": "GNU Affero General Public License version 3", "Apache-1.1": "Apache Software License, Version 1.1", "Apache-2.0": "Apache License, Version 2.0",
    "Artistic-2.0": "Artistic License 2.0", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "BSD-4-Clause": "BSD 4-Clause License", "BSL-1.0": "Boost Software License - Version 1.0",
    "CC-BY-3.0": "Creative Commons Attribution 3.0", "CC-BY-4.0": "Creative Commons Attribution 4.0", "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0", "CC-BY-NC-ND-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0", "CC-BY-SA-3.0": "Creative Commons Attribution-ShareAlike 3.0", "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0",
    "CC0-1.0": "Creative Commons Zero v1.0 Universal", "CDDL-1.0": "Common Development and Distribution License 1.0", "CECILL-2.1": "CeCILL Free Software License Agreement v2.1", "CPL-1.0": "Common Public License 1.0", "ECL-2.0": "Educational Community License v2.0",
    "EPL-1.0": "Eclipse Public License - v 1.0", "EPL-2.0": "Eclipse Public License - v 2.0", "EUPL-1.2": "European Union Public Licence v. 1.2", "GFDL-1.3": "GNU Free Documentation License, Version 1.3", "GPL-2.0": "GNU General Public License version 2",
    "GPL-3.0": "GNU General Public License version 3", "ISC": "ISC License", "LGPL-2.1": "GNU Lesser General Public License version 2.1", "LGPL-3.0": "GNU Lesser General Public License version 3", "LPPL-1.3c": "LaTeX Project Public License v1.3c",
    "MIT": "MIT License", "MPL-1.1": "Mozilla Public License 1.1", "MPL-2.0": "Mozilla Public License 2.0", "MS-PL": "Microsoft Public License (Ms-PL)", "NCSA": "University of Illinois/NCSA Open Source License", "ODbL-1.0": "Open Database License v1.0",
    "OFL-1.1": "SIL Open Font License, Version 1.1", "OSL-3.0": "Open Software License version 3.0", "PostgreSQL": "PostgreSQL License", "PSF-2.0": "Python Software Foundation License Version 2", "Unlicense": "The Unlicense", "UPL-1.0": "Universal Permissive License v1.0",
    "Vim": "Vim License", "WTFPL": "Do What The F*ck You Want To Public License", "Zlib": "zlib License",
}
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_END = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: Wordings of common notices (id, wording).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", _BSD),  # the sentence that its kinds share, where nothing more is there
    ("BSD-2-Clause", _BSD + _BSD_2),
    ("BSD-3-Clause", _BSD + _BSD_2 + _BSD_3),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("MIT", _MIT + _MIT_END),
    ("ISC", _ISC + _ISC_END),
    ("BSD-2-Clause", _BSD + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_2 + _BSD_3 + _BSD_END),
    *((i, f"Licensed under the {name}.") for i, name in NAMES.items()),
    *((i, name) for i, name in NAMES.items()),
    *((i, f"SPDX-License-Identifier: {i}") for i in NAMES),
)

_CUE = re.compile(r"licen[sc]|rights[\W_]+reserved|permission|redistribut|copyright|public[\W_]+domain|creative[\W_]+commons|free[\W_]+software", re.IGNORECASE)


def words(text: str) -> list[str]:
    """Lower-cased words with inner dots, dashes and slashes; other punctuation falls away."""
    return re.findall(r"[^\W_]+(?:[.\-/:]+[^\W_]+)*", text.lower())


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST):
        self.least = least
        self.templates = [(name, words(text)) for name, text in templates]
        self.bags = [Counter(w) for _, w in self.templates]
        self.alone = zstandard.ZstdCompressor(level=3)
        self.given = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode() * (1 + 8 // len(" ".join(w))), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for _, w in self.templates
        ]
        self.reach = max(len(w) + self.odd(w) for _, w in self.templates)

    def odd(self, theirs: list[str]) -> int:
        """Differing words that a notice of this wording may have."""
        return int(2 * (1 - self.least) * len(theirs) + 1e-9)

    def windows(self, mine: list[str]) -> Iterator[tuple[int, int]]:
        """Runs of words (first, after the last) that hold every notice with a cue in it, whole in one of them."""
        starts, n = [], 0
        for w in mine:
            starts.append(n)
            n += len(w) + 1
        runs: list[list[int]] = []
        for m in _CUE.finditer(" ".join(mine)):
            at, last = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1)
            a, b = max(0, last - self.reach), min(len(mine), at + self.reach)
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        for a, b in runs:
            for at in range(a, b, WINDOW_WORDS - self.reach):
                stop = min(b, at + WINDOW_WORDS)
                yield at, stop
                if stop == b:
                    break

    def saved(self, i: int, raw: bytes) -> int:
        """Bytes that a template saves as a dictionary."""
        return len(self.alone.compress(raw)) - len(self.given[i].compress(raw))

    def better(self, i: int, got: tuple, left: list[str | None], asked: list[int]) -> tuple[int, tuple]:
        """Of a confirmed notice's words, compressed by themselves, the template that saves most and is confirmed there too; of those that save as much the one with fewer differing words."""
        p, q = got[1:3]
        raw = " ".join(left[p:q]).encode()
        saved = {j: self.saved(j, raw) for j in asked}
        best = (saved[i], -len(got[3]), -i, got)
        for j in sorted((j for j in asked if saved[j] >= saved[i] and j != i), key=lambda j: -saved[j]):
            if saved[j] < best[0]:
                break
            theirs = self.templates[j][1]
            a = max(0, p - self.odd(theirs))
            if there := self.compare(theirs, left[a : q + self.odd(theirs)]):
                best = max(best, (saved[j], -len(there[3]), -j, (there[0], a + there[1], a + there[2], there[3])))
        return -best[2], best[3]

    def compare(self, theirs: list[str], mine: list[str | None]) -> tuple[int, int, int, list[str]] | None:
        """Held words, first word, word after the last and differing words of a notice of this wording."""
        slack, least = self.odd(theirs), self.least * len(theirs)
        left = list(mine)
        while True:
            run = SequenceMatcher(None, theirs, left, autojunk=False).find_longest_match()
            if run.size * (slack + 1) < least:  # so few differences leave a longer run of equal words
                return None
            a = max(0, run.b - run.a - slack)
            near = mine[a : run.b + len(theirs) - run.a + slack]
            ops = SequenceMatcher(None, theirs, near, autojunk=False).get_opcodes()
            same = [(o[3], o[4]) for o in ops if o[0] == "equal"]
            held = sum(q - p for p, q in same)
            p, q = same[0][0], same[-1][1]
            if held >= least and None not in near[p:q]:
                inside = [o for o in ops if o[0] != "equal" and (o[2] > o[1] or p <= o[3] < q)]
                odd = [w for o in inside for w in [*("-" + x for x in theirs[o[1] : o[2]]), *("+" + x for x in near[max(o[3], p) : min(o[4], q)])]]
                if len(odd) <= slack and sum(w[0] == "+" for w in odd) <= slack / 2:
                    return held, a + p, a + q, odd
            left[run.b : run.b + run.size] = [None] * run.size

    def scan(self, text: str) -> list[tuple[str, int, int, float, float, str]]:
        """``(license_id, first_line, stop_line, reduction, coverage, differences)`` for each confirmed notice."""
        if not _CUE.search(text):
            return []
        per_line = [words(x) for x in text.split("\n")]
        mine = [w for line in per_line for w in line]
        line_of = [i for i, line in enumerate(per_line) for _ in line]
        found = []
        for a, b in self.windows(mine):
            left: list[str | None] = list(mine[a:b])
            asked = list(range(len(self.templates)))
            while asked:
                bag = Counter(left)
                asked = [i for i in asked if sum(min(n, bag[w]) for w, n in self.bags[i].items()) >= self.least * len(self.templates[i][1])]
                raw = " ".join(w or "" for w in left).encode()
                saved = {i: self.saved(i, raw) for i in asked}
                for i in sorted(asked, key=lambda i: (-saved[i], i)):
                    if got := self.compare(self.templates[i][1], left):
                        i, (held, p, q, odd) = self.better(i, got, left, asked)
                        mine_alone = " ".join(left[p:q]).encode()
                        found.append((self.saved(i, mine_alone), held, -len(odd), -i, a + p, a + q, odd, self.saved(i, mine_alone) / len(self.alone.compress(mine_alone))))
                        left[p:q] = [None] * (q - p)
                        break
                    asked.remove(i)  # nor will it be there when more words have been taken out
        out: dict[tuple[str, int, int], tuple[float, float, str]] = {}
        taken: set[int] = set()
        for _, held, _, i, p, q, odd, fall in sorted(found, key=lambda f: f[:6], reverse=True):
            name, theirs = self.templates[-i]
            if taken.isdisjoint(range(p, q)):
                taken.update(range(p, q))
                out.setdefault((name, line_of[p], line_of[q - 1] + 1), (round(fall, 6), held / len(theirs), " ".join(odd)))
        return [(*k, *v) for k, v in sorted(out.items())]


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id, license_id, first_line, stop_line, reduction, coverage, differences``; ``differences`` is empty where the wording is exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for b in chunks(batches):
            rows = [(i, *hit) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for hit in scanner.scan(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "license_id", "first_line", "stop_line", "reduction", "coverage", "differences"])

    return doc_text(docs).mapInArrow(run, "doc_id long, license_id string, first_line int, stop_line int, reduction double, coverage double, differences string")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("exact", F.col("differences") == "")


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE: dict[str, str] = {}
