"""License scans by conditional compression.

A block of text that repeats a license compresses far better once the compressor knows that license. Candidate blocks lie
around words that serve as cues; each is compressed alone and with each template of which it has enough words as a
zstandard raw dictionary, templates are ranked by the size they save, and the best is confirmed by the words that differ
and by what the template saves on those words alone.
"""

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words around which texts are looked at; a template without any of them adds its longest word.
CUE = re.compile(r"licen[cs]e|copyright|permission|redistribut|warrant|spdx|public\W+domain|all\W+rights\W+reserved", re.IGNORECASE)
#: A template has to save this part of the compressed size of the words it is confirmed by; words behind them do not count.
LEAST_SAVED = 0.35
#: Templates of a block that are compared, in the order of what they save; all that save as much as the last are.
CONFIRMED = 3
#: Words that may differ, as a part of the template's.
MOST_DIFFERENT = 0.15
LEVEL = 3
#: Characters of blocks whose ranking is remembered.
SEEN_CHARS = 16 << 20

#: Fixed texts: the notices as their licenses word them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-line": "Released into the public domain under CC0 1.0.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "BSD-line": "Released under the BSD License.",
    "All-rights-reserved-line": "All rights reserved.",
    "MIT-SPDX": "SPDX-License-Identifier: MIT",
    "Apache-2.0-SPDX": "SPDX-License-Identifier: Apache-2.0",
    "BSD-3-Clause-SPDX": "SPDX-License-Identifier: BSD-3-Clause",
    "GPL-2.0-only-SPDX": "SPDX-License-Identifier: GPL-2.0-only",
    "GPL-3.0-or-later-SPDX": "SPDX-License-Identifier: GPL-3.0-or-later",
    "MPL-2.0-SPDX": "SPDX-License-Identifier: MPL-2.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}


_WORD = re.compile(r"\S+")


def _words(text: str) -> list[str]:
    """Words as compared: lower case, without the marks of comments and punctuation around them."""
    return [w for w, _, _ in _placed(text, 0, len(text))]


def _placed(text: str, start: int, stop: int) -> Iterator[tuple[str, int, int]]:
    for m in _WORD.finditer(text, start, stop):
        if w := m[0].lower().strip("*#/;,.:\"'()[]<>-!"):
            yield w, m.start(), m.end()


class Scanner:
    def __init__(self, templates: dict[str, str], least_saved: float = LEAST_SAVED, most_different: float = MOST_DIFFERENT):
        self.least_saved, self.most_different = least_saved, most_different
        self.names = list(templates)
        self.words = [_words(templates[n]) for n in self.names]
        self.counts = [Counter(w) for w in self.words]
        wordings = [" ".join(w) for w in self.words if w]
        own = sorted({max(w.split(" "), key=len) for w in wordings if not CUE.search(w)})
        self.cue = re.compile("|".join([CUE.pattern, *map(re.escape, own)]), re.IGNORECASE)
        # (words before the first cue, words) of the templates: what to take around a cue in a text.
        self.shapes = sorted({(w[: self.cue.search(w).start()].count(" "), w.count(" ") + 1) for w in wordings})
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.given = [
            zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for w in self.words
        ]
        self.seen: dict[tuple[str, tuple[int, ...]], list[tuple[float, int]]] = {}
        self.held = 0

    def ranked(self, block: str, templates: tuple[int, ...]) -> list[tuple[float, int]]:
        """(part of the compressed size saved, template) of these templates, most first; ties in the order of the templates."""
        if (known := self.seen.get((block, templates))) is not None:
            return known
        data = block.encode()
        size = len(self.alone.compress(data))
        out = sorted(((1 - len(self.given[k].compress(data)) / size, k) for k in templates), key=lambda x: (-x[0], x[1]))
        if self.held > SEEN_CHARS:
            self.seen.clear()
            self.held = 0
        self.seen[block, templates] = out
        self.held += len(block) + 200
        return out

    @staticmethod
    def before(text: str, start: int, stop: int, words: int) -> list[tuple[str, int, int]]:
        """The last so many words between two places, of any length."""
        reach = 40 * words + 80
        while True:
            # A word that is cut at the beginning is not taken for one.
            at = max(start, stop - reach)
            found = list(_placed(text, at, stop))
            if at > start and found and found[0][1] == at and not text[at - 1].isspace():
                del found[0]
            if len(found) >= words or at == start:
                return found[len(found) - min(words, len(found)) :]
            reach *= 4

    def confirm(self, words: list[str], k: int) -> tuple[int, int, int, float]:
        """(words that differ, first and last + 1 word of the block, similarity), where the template ends with its last shared word."""
        matcher = SequenceMatcher(None, words, self.words[k], autojunk=False)
        same = [m for m in matcher.get_matching_blocks() if m.size]
        if not same:
            return len(self.words[k]), 0, 0, 0.0
        first, last = same[0].a, same[-1].a + same[-1].size
        shared = sum(m.size for m in same)
        different = max(last - first - shared, 0) + len(self.words[k]) - shared
        return different, first, last, shared / max(last - first, len(self.words[k]))

    def scan(self, text: str) -> list[tuple[str, int, int, float, int, bool]]:
        """(license, start and stop in characters, part saved, words that differ, whether the wording is exact)."""
        if not self.shapes or not self.cue.search(text):
            return []
        found: list[tuple[str, int, int, float, int, bool]] = []
        before, after = max(b for b, _ in self.shapes), max(n for _, n in self.shapes)
        at = done = first = upto = 0
        while cue := self.cue.search(text, at):
            # The start of the cue's word; where no white space lies between, it is that of the cue before.
            here = cue.start()
            while here > upto and not text[here - 1].isspace():
                here -= 1
            first, upto = (first if here == upto else here), max(upto, cue.start())
            head = self.before(text, done, first, before)
            tail = list(islice(_placed(text, first, len(text)), after + after // 5 + 3))
            best = None
            # No block around the cue has words that the widest has not.
            possible = self._possible(Counter(w for w, _, _ in head + tail), range(len(self.counts)))
            for b, n in self.shapes if possible else ():
                ahead = head[len(head) - min(b, len(head)) :]
                for size in (n - b, n - b + n // 5 + 2):
                    best = self._best(cue.start(), ahead + tail[:size], possible, best)
            at = cue.end()
            if best is not None:
                found.append(best[1])
                at = done = first = upto = best[1][2]
        return found

    def _possible(self, has: Counter, templates: Iterable[int]) -> tuple[int, ...]:
        """Those that a block of these words may hold: words that a template has and the block has not differ in any comparison."""
        return tuple(k for k in templates if (c := self.counts[k]) and sum(n - min(n, has[w]) for w, n in c.items()) <= self.most_different * len(self.words[k]))

    def _best(self, cue: int, block: list[tuple[str, int, int]], templates: tuple[int, ...], best):
        words = [w for w, _, _ in block]
        possible = self._possible(Counter(words), templates)
        if not possible:
            return best
        ranked = self.ranked(" ".join(words), possible)
        last = ranked[min(CONFIRMED, len(ranked)) - 1][0]
        for saved, k in ranked:
            if saved < last:
                break
            different, a, b, similar = self.confirm(words, k)
            if different <= self.most_different * len(self.words[k]) and block[a][1] <= cue < block[b - 1][2]:
                saved = self.ranked(" ".join(words[a:b]), (k,))[0][0]
                if saved < self.least_saved:
                    continue
                got = (self.names[k], block[a][1], block[b - 1][2], saved, different, different == 0)
                rank = (similar * len(self.words[k]), saved, -k)
                if best is None or rank > best[0]:
                    best = rank, got
        return best


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least_saved: float = LEAST_SAVED, most_different: float = MOST_DIFFERENT) -> DataFrame:
    """(id, license, start, stop, saved, different_words, exact) for each license notice in each whole text.

    Words are compared in lower case without marks around them; ``exact`` means that none differs. Of overlapping
    notices the one with most shared words stands. One pass without a shuffle. Null and empty texts hold none; null and
    repeated ids keep their rows; other columns are ignored; an empty table gives an empty result.
    """
    chosen = dict(TEMPLATES if templates is None else templates)
    names, kinds = ("id_of_row", "license", "start", "stop", "saved", "different_words", "exact"), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, least_saved, most_different)
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column("id_of_row").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for x in scanner.scan(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))], names=list(names))

    rows = docs.select(F.col(id_col).cast("long").alias("id_of_row"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "id_of_row long, license string, start long, stop long, saved double, different_words int, exact boolean")
    return out.withColumnRenamed("id_of_row", id_col)
