"""License scanning by conditional compression.

The words around mentions of licensing are cut into windows of bounded length
that overlap by the longest notice. Each is compressed alone and with each
template as a raw zstandard dictionary. Templates are ranked by how much they
shrink it; the first of them that has a line which the exact differences in
wording confirm wins, wherever the stretch that the line fits begins and ends.
So a notice may be wrapped over lines, commented, or stand inside a longer
line. What is left of the window is looked at again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public notices by license, as sentences or paragraphs of them; the usual wordings of one license are lines of one template. Words that two licenses share stand in one of them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.\nSPDX-License-Identifier: Apache-2.0",
    "MIT": "Released under the MIT License.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThis project is licensed under the MIT License.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nSPDX-License-Identifier: MIT",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.\nSPDX-License-Identifier: GPL-3.0-or-later\nSPDX-License-Identifier: GPL-3.0-only",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nReleased under the BSD 3-Clause License.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.\nSPDX-License-Identifier: BSD-3-Clause",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.\nThis work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.\nThis work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.\nReleased into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.\nThis program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\nSPDX-License-Identifier: GPL-2.0-or-later\nSPDX-License-Identifier: GPL-2.0-only",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.\nSPDX-License-Identifier: LGPL-2.1-or-later",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\nIf a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.\nLicensed under the Mozilla Public License, Version 2.0.\nSPDX-License-Identifier: MPL-2.0",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.\nSPDX-License-Identifier: BSD-2-Clause",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.\nReleased under the ISC License.\nSPDX-License-Identifier: ISC",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.\nThis work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
CUES = r"(?i)licen[sc]e|copyright|public domain|all rights reserved|spdx|warrant|redistribut|cc[ -]by|\bcc0\b|permission (?:is hereby|to use)|subject to the terms"
#: Distinct blocks that a worker remembers; it forgets all when there are more.
MEMORY_BLOCKS = 50_000
MEMORY_CHARS = 500
_WORD = re.compile(r"\w+")
_SIGNS = re.compile(r"[^\w\s]*")


class Scanner:
    """Compares stretches of text with templates."""

    def __init__(self, templates: dict[str, str], max_changed: float = 0.2):
        self.max_changed = max_changed
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.conditional = {
            name: zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, text in templates.items()
        }
        lines = {name: [w for line in text.split("\n") if (w := _WORD.findall(line.lower()))] for name, text in templates.items()}
        self.number = {w: k for k, w in enumerate(sorted({w for own in lines.values() for line in own for w in line}))}
        #: The lines of each template as numbers of words, how often each has each word, and the words of the template's name in it.
        self.lines = {name: [np.array([self.number[w] for w in line], np.int64) for line in own] for name, own in lines.items()}
        self.bags = {name: np.array([np.bincount(line, minlength=len(self.number)) for line in own]).reshape(len(own), -1) for name, own in self.lines.items()}
        self.own = {name: [{self.number[w] for w in set(_WORD.findall(name.lower())) & set(line)} for line in own] for name, own in lines.items()}
        #: Words around a mention that a notice with it may reach to.
        self.reach = max((len(w) + int(max_changed * len(w)) for own in lines.values() for w in own), default=1)
        self.cue = re.compile(CUES)
        self.known: dict[str, tuple] = {}

    def sizes(self, block: str) -> tuple[int, dict[str, int]]:
        """Bytes of a stretch alone, and with each template."""
        found = self.known.get(block)
        if found is None:
            raw = block.encode()
            found = len(self.plain.compress(raw)), {name: len(c.compress(raw)) for name, c in self.conditional.items()}
            if len(self.known) >= MEMORY_BLOCKS:
                self.known.clear()
            if len(block) <= MEMORY_CHARS:
                self.known[block] = found
        return found

    def scan(self, text: str) -> list[tuple[int, str, int, int, int, bool]]:
        """Line, best template, bytes alone, bytes with it, words changed and whether confirmed: of notices, and of lines that mention licensing outside them."""
        cues = [m.span() for m in self.cue.finditer(text)]
        if not cues:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        words = np.array([self.number.get(text[a:b].lower(), -1) for a, b in spans], np.int64)
        starts = [a for a, _ in spans]
        mentions = [max(0, bisect_right(starts, a) - 1) for a, _ in cues]
        breaks = [m.start() for m in re.finditer("\n", text)]
        notices, out = [], []
        for low, high in self._around(mentions, len(words)):
            for a, b, name, changed in self._notices(text, spans, words, mentions, low, high):
                first, end = spans[a][0], _SIGNS.match(text, spans[b - 1][1]).end()
                alone, with_template = self.sizes(text[first:end])
                notices.append((first, end))
                out.append((bisect_left(breaks, first), name, alone, with_template[name], changed, True))
        notices.sort()
        ends = [end for _, end in notices]
        seen = -1
        for a, b in cues:
            line = bisect_left(breaks, a)
            k = bisect_right(ends, a)
            if line == seen or k < len(notices) and notices[k][0] < b:
                continue
            seen = line
            begin, end = breaks[line - 1] + 1 if line else 0, breaks[line] if line < len(breaks) else len(text)
            alone, with_template = self.sizes(text[begin:end])
            best = min(with_template, key=lambda name: (with_template[name], name))
            out.append((line, best, alone, with_template[best], self._least_changed(best, words[bisect_left(starts, begin) : bisect_left(starts, end)]), False))
        return sorted(out)

    def _around(self, mentions: list[int], n_words: int) -> list[list[int]]:
        """Stretches of words that a notice with a mention may lie in."""
        found: list[list[int]] = []
        for at in mentions:
            low, high = max(0, at - self.reach), min(n_words, at + self.reach + 1)
            if found and low <= found[-1][1]:
                found[-1][1] = high
            else:
                found.append([low, high])
        return found

    def _notices(self, text: str, spans: list, words: np.ndarray, mentions: list[int], low: int, high: int) -> Iterator[tuple[int, int, str, int]]:
        """Notices of a stretch of any length, from windows of twice the reach, so that each notice lies whole in one; windows overlap by the reach."""
        todo = [(low, high)]
        while todo:
            low, high = todo.pop()
            at = low
            while at < high:
                end = min(at + 2 * self.reach, high)
                found = self._best(text, spans, words, mentions, at, end)
                if found:
                    yield found
                    todo.append((at, found[0]))
                    at = found[1]
                elif end == high:
                    break
                else:
                    at += self.reach

    def _best(self, text: str, spans: list, words: np.ndarray, mentions: list[int], low: int, high: int) -> tuple[int, int, str, int] | None:
        """The notice of the template that shrinks a window most, of those whose wording confirms it."""
        if low >= high or bisect_left(mentions, high) == bisect_left(mentions, low):
            return None
        block = text[spans[low][0] : spans[high - 1][1]]
        alone, with_template = self.sizes(block)
        part = words[low:high]
        have = np.bincount(part[part >= 0], minlength=len(self.number))
        for name in sorted((n for n, size in with_template.items() if size < alone), key=lambda n: (with_template[n], n)):
            for changed, a, b in self._fitting(name, part, have):
                if bisect_left(mentions, low + b) > bisect_left(mentions, low + a):
                    own_alone, own_with = self.sizes(text[spans[low + a][0] : spans[low + b - 1][1]])
                    if own_with[name] < own_alone:
                        return low + a, low + b, name, changed
        return None

    def _fitting(self, name: str, words: np.ndarray, have: np.ndarray) -> list[tuple[int, int, int]]:
        """Stretches of ``words`` that lines of a template fit within the changes allowed, with the words changed; those that explain most come first."""
        found = []
        missing = self.bags[name].sum(axis=1) - np.minimum(self.bags[name], have).sum(axis=1)
        for line, own, lacks in zip(self.lines[name], self.own[name], missing.tolist()):
            allowed = int(self.max_changed * len(line))
            if lacks > allowed:
                continue
            changed, start, end = self._fit(line, words)
            if changed <= allowed and start < end and own.issubset(words[start:end].tolist()):  # another license's name is no small change
                found.append((len(line) - 2 * changed, changed, start, end))
        return [x[1:] for x in sorted(found, key=lambda x: -x[0])]

    def _least_changed(self, name: str, words: np.ndarray) -> int:
        """Words changed in the line of a template that fits best, whether that is allowed or not."""
        have = np.bincount(words[words >= 0], minlength=len(self.number))
        missing = (self.bags[name].sum(axis=1) - np.minimum(self.bags[name], have).sum(axis=1)).tolist()
        best = None
        for k in sorted(range(len(missing)), key=missing.__getitem__):
            if best is not None and missing[k] >= best:
                break
            cost = int(self._costs(self.lines[name][k], words, True).min())
            best = cost if best is None else min(best, cost)
        return len(words) if best is None else best

    @staticmethod
    def _costs(line: np.ndarray, words: np.ndarray, free: bool) -> np.ndarray:
        """For each place in ``words`` the changes that make of the line what ends there; ``free``: wherever it begins."""
        at = np.arange(len(words) + 1)
        row = np.zeros(len(words) + 1, np.int64) if free else at.copy()
        for w in line.tolist():
            step = row + 1
            step[1:] = np.minimum(step[1:], row[:-1] + (words != w))
            row = np.minimum.accumulate(step - at) + at
        return row

    def _fit(self, line: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
        """Words inserted, deleted or replaced in the stretch of ``words`` that a line fits best, and where it starts and ends."""
        ends = self._costs(line, words, True)
        end = int(ends.argmin())
        back = self._costs(line[::-1], words[max(0, end - 2 * len(line)) : end][::-1], False)
        return int(ends[end]), end - int(back.argmin()), end


def scan_documents(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, max_changed: float = 0.2) -> DataFrame:
    """A row for each block: ``doc_col``, ``block`` (the number of the line where it begins), ``license``, ``plain_bytes``, ``dict_bytes``, ``changed_words``, ``confirmed``.

    Blocks are the notices found, which mention licensing and differ from a
    line of a template in no more than ``max_changed`` of its words, wherever
    they begin and end; and, not confirmed, the lines with a mention outside
    them. Of templates that shrink a window alike the first by name counts, of
    lines that explain as many words the first of the template. Null and empty
    texts have no blocks; texts of any length are scanned whole, in time that
    grows with their length; repeated rows are scanned each; an empty table
    gives an empty result; other columns are ignored.
    """
    templates = templates or TEMPLATES
    rows = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).where(F.regexp_like("text", F.lit(CUES)))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, max_changed)
        names = ["block", "license", "plain_bytes", "dict_bytes", "changed_words", "confirmed"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column(1)):
                found = scanner.scan(text.as_py())
                at += [k] * len(found)
                out += found
            columns = [pa.array([x[j] for x in out], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc", *names])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, block long, license string, plain_bytes long, dict_bytes long, changed_words long, confirmed boolean"
    return rows.mapInArrow(scanned, schema).withColumnRenamed("doc", doc_col)
