"""Licence scan: passages of normalised text compared to licence templates by the Dice coefficient over word bigrams.

Normalised words are runs of ASCII letters and digits, lower-cased. For every template the passages with a Dice coefficient
of THRESHOLD or more are searched among all windows of words of the text. Two bounds that follow from the threshold
prune: a window has between t / (2 - t) and (2 - t) / t times the template's bigrams, so templates and windows of
other sizes are never compared (a window is at most as long as that, repeats counted, so a licence given twice is two
passages); and it shares at least t / (2 - t) of them, so that many of the template's bigrams must
lie close enough together, and a text without any of the signature words (chosen so that no match can do without) is
passed over at once. Each start offers its best window; best passages win; those that overlap a better one are dropped.
Starts are taken in blocks of a fixed size, so time is the text's length times the template's and memory in proportion to
the text.

Edge cases: null or empty texts have no match; ties go to the longer passage, then the earlier, then the template's name;
repeated rows each get their row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import null_safe_texts, small, table

THRESHOLD = 0.8
#: Places of windows that are looked at together.
BLOCK = 1 << 20
WORD = re.compile("[A-Za-z0-9]+")

# Public licence texts and notices.
WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "BSD-2-Clause": f"{BSD_CONDITIONS} {BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{BSD_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_DISCLAIMER}",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {WARRANTY}",
    "MIT-notice": "Released under the MIT License",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def normalised(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Templates:
    """Templates as bigram sets, with the bounds that follow from the threshold."""

    def __init__(self, texts: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.sets = {name: frozenset(bigrams(normalised(text))) for name, text in sorted(texts.items())}
        ratio = threshold / (2 - threshold)
        self.needed = {name: int(np.ceil(ratio * len(s) - 1e-9)) for name, s in self.sets.items()}
        self.largest = {name: int(np.floor(len(s) / ratio + 1e-9)) for name, s in self.sets.items()}
        self.signature = self.signature_words()

    def signature_words(self) -> list[str]:
        """Words such that any window that matches a template holds one of them."""
        chosen: list[str] = []
        while True:
            open_sets = {n: [b for b in s if not set(b) & set(chosen)] for n, s in self.sets.items()}
            short = [b for n, bs in open_sets.items() if len(bs) >= self.needed[n] for b in bs]
            if not short:
                return chosen
            count = Counter(w for b in short for w in b if len(w) > 4)
            if not count:
                return [*chosen, *sorted({w for b in short for w in b})]
            chosen.append(max(sorted(count), key=count.__getitem__))

    def windows(self, codes: np.ndarray, before: np.ndarray, name: str, known: dict[tuple[str, str], int]):
        """(Dice coefficients, first, last bigrams): the best window of every start, both ends being bigrams of the template.

        codes: the text's bigrams as numbers; before: where each bigram stood last, -1 at first; known: their numbers.
        """
        wanted, need, largest = self.sets[name], self.needed[name], self.largest[name]
        marks = [known[p] for p in wanted if p in known]
        if len(marks) < need:
            return
        table_ = np.zeros(len(known), bool)
        table_[marks] = True
        hit = np.append(table_[codes], np.zeros(largest, bool))  # no window ends past the text
        before = np.append(before, np.full(largest, len(codes)))
        sums = np.concatenate(([0], np.cumsum(hit)))
        starts = np.flatnonzero(hit[: len(codes)])
        starts = starts[sums[starts + largest] - sums[starts] >= need]
        step, span = max(1, BLOCK // largest), np.arange(largest)
        for lo in range(0, len(starts), step):
            start = starts[lo : lo + step]
            at = start[:, None] + span
            new, here = before[at] < start[:, None], hit[at]
            dice = np.where(here, 2 * np.cumsum(new & here, 1, dtype=np.int32) / (np.cumsum(new, 1, dtype=np.int32) + len(wanted)), 0)
            last = largest - 1 - dice[:, ::-1].argmax(1)
            best = dice[np.arange(len(start)), last]
            keep = best >= self.threshold
            yield best[keep], start[keep], start[keep] + last[keep]

    def find(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, template, Dice coefficient) of the best passages, in order; code points, end exclusive."""
        low = text.lower()
        if not any(w in low for w in self.signature):
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        known: dict[tuple[str, str], int] = {}
        codes = np.array([known.setdefault(p, len(known)) for p in bigrams([text[a:b].lower() for a, b in spans])], np.int64)
        order = np.argsort(codes, kind="stable")
        before = np.full(len(codes), -1)
        same = np.flatnonzero(codes[order[1:]] == codes[order[:-1]])
        before[order[same + 1]] = order[same]
        found = [(name, *w) for name in self.sets for w in self.windows(codes, before, name, known)]
        if not found:
            return []
        names = np.repeat([name for name, *_ in found], [len(w[1]) for w in found])
        dice, first, last = (np.concatenate([w[k] for w in found]) for k in (1, 2, 3))
        taken: list[tuple[int, int, str, float]] = []
        free = np.ones(len(codes) + 2, bool)
        for i in np.lexsort((names, first, first - last, -dice)).tolist():
            a, b = int(first[i]), int(last[i])
            if free[a] and free[b + 1] and free[a : b + 2].all():
                free[a : b + 2] = False
                taken.append((spans[a][0], spans[b + 1][1], str(names[i]), float(dice[i])))
        return sorted(taken)


def scan(docs: DataFrame, texts: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches, licenses (start:end:template, comma-joined), best_license, best_dice."""
    chosen = texts or TEMPLATES

    def run(batches):
        templates = Templates(chosen, threshold)
        for batch in small(batches):
            found = [templates.find(t) for t in null_safe_texts(batch.column("text"))]
            best = [max(f, key=lambda x: (x[3], -x[0])) if f else (0, 0, None, None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(f"{a}:{b}:{n}" for a, b, n, _ in f) for f in found], pa.string()), pa.array([b[2] for b in best], pa.string()), pa.array([b[3] for b in best], pa.float64())],
                names=["doc_id", "n_matches", "licenses", "best_license", "best_dice"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_matches long, licenses string, best_license string, best_dice double")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
