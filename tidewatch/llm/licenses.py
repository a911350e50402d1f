"""License scan by conditional compression.

A block of words around a cue (license, copyright, ...) is compressed alone and then with each template as raw
dictionary: what the template explains of the block is what it saves.  Templates are ranked by that, and each is
confirmed by the exact differences in wording, so a license with another version number or a changed condition is not taken for the
one it resembles.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Wording of common license notices, by SPDX identifier where there is one.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
)
CUE = r"(?i)licen[sc]e|copyright|permission|redistribut|rights reserved|public domain"
WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")
#: Words that may differ, per hundred words of the template: none in a one-line notice.
DIFFER = 5


def exact(block: list[str], want: list[str]) -> tuple[int, int, list[str]] | None:
    """The first place of ``want`` in ``block``."""
    n = len(want)
    at = next((i for i, w in enumerate(block) if w == want[0] and block[i : i + n] == want), None)
    return None if at is None else (at, at + n, [])


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words = [WORD.findall(t.lower()) for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.reach = max((len(w) + 2 * (len(w) * DIFFER // 100) for w in self.words), default=0)  # words of the longest place
        self.alone = zstandard.ZstdCompressor(level=9, write_content_size=False)
        dicts = [zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for w in self.words]
        self.own = [len(self.alone.compress(" ".join(w).encode())) for w in self.words]
        self.given = [zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_dict_id=False) for d in dicts]

    def blocks(self, text: str) -> Iterator[list[tuple[str, int]]]:
        """Words (with their offsets) around the cues; long stretches come in blocks that overlap by the longest template."""
        words = [(m[0].lower(), m.start()) for m in WORD.finditer(text)]
        cues = [k for k, (w, _) in enumerate(words) if re.search(CUE, w) or w in ("rights", "public")]
        spans: list[list[int]] = []
        for k in cues:
            lo, hi = max(0, k - self.reach), min(len(words), k + self.reach)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        for lo, hi in spans:
            for at in range(lo, max(lo + 1, hi - self.reach), 2 * self.reach):
                yield words[at : min(hi, at + 3 * self.reach)]

    def savings(self, block: list[str]) -> list[tuple[float, int]]:
        """(bytes saved over the template's own cost, template), largest first.

        What a template saves is set against its length, so that a long license does not win for one line that it holds.
        """
        data = " ".join(block).encode()
        alone = len(self.alone.compress(data))
        out = [((alone - len(c.compress(data))) / min(alone, self.own[k]), k) for k, c in enumerate(self.given)]
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def possible(self, have: Counter, k: int) -> bool:
        """Whether the block with these word counts lacks no more words of template ``k`` than may differ.

        What a template saves is not asked: a one-line notice saves a few bytes, which the coding of the block may eat.
        """
        return sum((self.counts[k] - have).values()) <= len(self.words[k]) * DIFFER // 100

    def confirm(self, block: list[str], k: int) -> Iterator[tuple[int, int, list[str]]]:
        """Places (from, to) of template ``k`` in ``block`` and the differences in wording, as -word and +word.

        The place with the fewest differences comes first, then those to the left and right of it, so every copy is
        found whatever words it lacks.
        """
        want, spans = self.words[k], [(0, len(block))]
        while spans:
            lo, hi = spans.pop()
            here = block[lo:hi]
            if not self.possible(Counter(here), k):
                continue
            found = self.aligned(here, k) if len(want) * DIFFER >= 100 else exact(here, want)
            if found:
                a, z, diff = found
                yield lo + a, lo + z, diff
                spans += [(lo, lo + a), (lo + z, hi)]

    def aligned(self, block: list[str], k: int) -> tuple[int, int, list[str]] | None:
        """The place of ``block`` that differs least from template ``k``, if that is within what may differ.

        Row i of the table has the least number of words lacking or added between the first j words of the template
        and some stretch of the block that ends at i.
        """
        want, allowed = self.words[k], len(self.words[k]) * DIFFER // 100
        number = {w: n for n, w in enumerate(dict.fromkeys(want))}
        ids, row = np.array([number[w] for w in want]), np.arange(len(want) + 1)
        steps, far = row.copy(), np.int64(len(want) + len(block) + 1)
        table = [row]
        for w in block:
            best = row + 1  # the word is added
            best[0] = 0
            if w in number:
                best[1:] = np.minimum(best[1:], np.where(ids == number[w], row[:-1], far))
            row = np.minimum.accumulate(best - steps) + steps  # words of the template are lacking
            table.append(row)
        cost = np.array([r[-1] for r in table])
        for end in np.argsort(cost, kind="stable").tolist():
            if cost[end] > 2 * allowed:
                break
            i, j, lacking, added = end, len(want), [], []
            while j:
                if i and block[i - 1] == want[j - 1] and table[i][j] == table[i - 1][j - 1]:
                    i, j = i - 1, j - 1
                elif table[i][j] == table[i][j - 1] + 1:
                    j -= 1
                    lacking.append("-" + want[j])
                else:
                    i -= 1
                    added.append("+" + block[i])
            if len(lacking) <= allowed:
                return i, end, lacking[::-1] + added[::-1]
        return None

    def scan(self, text: str | None) -> list[dict]:
        """Confirmed licenses of a text, in order of place, each place once (the most words win)."""
        found = []
        for block in self.blocks(text or ""):
            words = [w for w, _ in block]
            have = Counter(words)
            for saved, k in self.savings(words):
                if not self.possible(have, k):
                    continue
                for a, z, diff in self.confirm(words, k):
                    found.append((block[a][1], block[z - 1][1] + len(words[z - 1]), a - z, self.names[k], round(saved, 4), diff))
        out, spans = [], []
        for start, stop, _, name, s, diff in sorted(found, key=lambda f: (f[2], len(f[5]), f[0], f[3])):
            if all(stop <= a or start >= z for a, z in spans):
                spans.append((start, stop))
                out.append({"license": name, "start": start, "stop": stop, "saved": s, "differences": diff})
        return sorted(out, key=lambda x: x["start"])


RESULT = "array<struct<license: string, start: int, stop: int, saved: double, differences: array<string>>>"


def scanner(templates: tuple[tuple[str, str], ...] = TEMPLATES):
    """Column function (text): the confirmed licenses."""
    held: list[Scanner] = []
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("saved", pa.float64()), ("differences", pa.list_(pa.string()))]))

    @F.arrow_udf(RESULT)
    def scan(text: pa.Array) -> pa.Array:
        if not held:
            held.append(Scanner(templates))
        return pa.array([held[0].scan(t) for t in text.to_pylist()], kind)

    return scan


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id and found, the licenses of each row's text with place (character offsets), saving and differing words.

    Texts without a cue are told by a pattern in the JVM; null and empty texts have no license.  Repeated rows get equal
    results, an empty table none.
    """
    cued = F.when(F.col("text").rlike(CUE), F.col("text"))
    return docs.select("doc_id", scanner(templates)(cued).alias("found"))
