"""License scans by template-markup matching.

A template is a text with regions: <<beginOptional>> ... <<endOptional>> may be left out, <<var;N>> stands for up to N words
of any kind; a template has mandatory words (ValueError otherwise). Each is compiled into an automaton over words; a place in a text is accepted when the wording outside of the regions
matches word for word. Texts are searched for the rarest fixed phrase of each template first (a template has no other
places), so that the automata run there alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .vectors import ALNUM, LOWER, texts, words

#: Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var;8>> BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""
_BSD_WARRANTY = """ THIS SOFTWARE IS PROVIDED BY <<var;12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL <<var;12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_WARRANTY = """ THE SOFTWARE IS PROVIDED "AS IS" AND <<var;12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;12>> BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
#: The licenses' own wording, and the label that each adds.
TEMPLATES = {
    "mit-text": """<<beginOptional>>MIT License<<endOptional>> <<beginOptional>>Copyright <<var;20>><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
Software. """ + _WARRANTY,
    "isc-text": """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<var;20>><<endOptional>>
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
    + _ISC_WARRANTY,
    "0bsd-text": """<<beginOptional>>Copyright <<var;20>><<endOptional>> Permission to use, copy, modify, and/or distribute this
software for any purpose with or without fee is hereby granted."""
    + _ISC_WARRANTY,
    "bsd-2-clause-text": "<<beginOptional>>Copyright <<var;20>><<endOptional>> " + _BSD + _BSD_WARRANTY,
    "bsd-3-clause-text": "<<beginOptional>>Copyright <<var;20>><<endOptional>> " + _BSD + """ <<beginOptional>>3<<endOptional>> Neither the
name of <<var;12>> nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
    + _BSD_WARRANTY,
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will <<var;12>> be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
but is not required. <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from
any source distribution.""",
    "bsl-1.0-text": """<<beginOptional>>Boost Software License Version 1.0 <<var;4>><<endOptional>> Permission is hereby granted,
free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. <<beginOptional>>In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication
for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
act of relinquishment in perpetuity of all present and future rights to this software under copyright law.<<endOptional>> THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at <<var;8>>""",
    "cc0-notice": """To the extent possible under law, <<var;12>> has waived all copyright and related or neighboring rights to
<<var;12>>""",
    "lgpl-notice": """<<var;6>> is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the
terms of the GNU Lesser General Public License as published by the Free Software Foundation<<beginOptional>>;<<endOptional>> either version <<var;3>> of the License, or
<<beginOptional>>(at your option)<<endOptional>> any later version.""",
    "apache-2.0-notice": """<<beginOptional>>Copyright <<var;20>><<endOptional>> Licensed under the Apache License, Version 2.0 (the
"License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<var;8>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-notice": """<<var;6>> is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation<<beginOptional>>;<<endOptional>> either version
<<var;3>> of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version.""",
    "mit-short": "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "cc-by-nc-short": "licensed under <<beginOptional>>a<<endOptional>> CC BY NC <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> <<beginOptional>>4 0<<endOptional>>",
    "cc-by-short": "licensed under <<beginOptional>>a<<endOptional>> CC BY <<beginOptional>>SA<<endOptional>> 4 0",
    "all-rights-reserved": "<<beginOptional>>copyright<<endOptional>> <<beginOptional>>c<<endOptional>> <<var;6>> all rights reserved",
    "apache-short": "<<beginOptional>>is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>version<<endOptional>> <<beginOptional>>2 0<<endOptional>>",
    "gpl-short": "<<beginOptional>>is<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> GNU <<beginOptional>>Lesser<<endOptional>> General Public License",
}
_MARK = re.compile(r"<<(beginOptional|endOptional|var;\d+)>>")


def tokens(text: str) -> list[str]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Automaton:
    """States 0..n; a step reads one word (None: any), a free move reads none."""

    def __init__(self, template: str):
        self.steps: list[tuple[str | None, int] | None] = []
        self.free: dict[int, list[int]] = {}
        fixed: list[list[str]] = [[]]
        before, self.lead, depth = [], 0, 0
        for i, part in enumerate(_MARK.split(template)):
            if i % 2 == 0:
                for w in tokens(part):
                    self.steps.append((w, len(self.steps) + 1))
                    if not depth:
                        fixed[-1].append(w)
                continue
            fixed.append([])
            if part == "beginOptional":
                before.append(len(self.steps))
                depth += 1
            elif part == "endOptional":
                self.free.setdefault(before.pop(), []).append(len(self.steps))
                depth -= 1
            else:
                first, n = len(self.steps), int(part[4:])
                self.steps += [(None, first + k + 1) for k in range(n)]
                for k in range(n):
                    self.free.setdefault(first + k, []).append(first + n)
        self.end = len(self.steps)
        #: The longest run of fixed words, up to eight: it is in every accepted text. reach: words that may stand before it.
        longest = max(fixed, key=lambda f: (len(f), sum(map(len, f))))
        if not longest:
            raise ValueError(f"a template without mandatory words accepts any text: {template!r}")
        self.anchor = longest[:8]
        for k in range(self.end):
            if [s[0] for s in self.steps[k : k + len(self.anchor)]] == self.anchor:
                self.reach = k
                break

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, text: list[str], start: int) -> int | None:
        """The end of the longest accepted run from start."""
        states, best, i = self._close({0}), None, start
        while states:
            if self.end in states:
                best = i
            if i == len(text):
                break
            states = self._close({t for s in states if s < self.end and (w := self.steps[s])[0] in (None, text[i]) for t in (w[1],)})
            i += 1
        return best

    def find(self, text: list[str], anchors: list[int]) -> list[tuple[int, int]]:
        """Accepted runs around the places of the anchor, the first start of each."""
        out: list[tuple[int, int]] = []
        for a in anchors:
            for start in range(max(0, a - self.reach, out[-1][1] if out else 0), a + 1):
                end = self.match(text, start)
                if end is not None and end >= a + len(self.anchor):
                    out.append((start, end))
                    break
        return out


def _phrase(ws: list[str]) -> bytes:
    return rb"[^0-9a-z\x80-\xff]+".join(re.escape(w.encode()) for w in ws)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. The base counts all places of PHRASES; templates add
    labels and spans (label:first word:end). score is the share of a text's words in base places and spans. Null and wordless
    texts have no words, null places, no labels and score 0. Repeated rows have equal results; an empty table gives an
    empty result; other columns of docs are ignored.
    """
    compiled = {k: Automaton(t) for k, t in (TEMPLATES if templates is None else templates).items()}
    edge, stop = rb"(?<![0-9a-z\x80-\xff])(?:", rb")(?![0-9a-z\x80-\xff])"
    base = re.compile(edge + b"|".join(b"(" + _phrase(p.split()) + b")" for p in PHRASES) + stop)
    names = list(PHRASES.values())
    size = [len(p.split()) for p in PHRASES]
    anchors = {k: re.compile(edge + _phrase(a.anchor) + stop) for k, a in compiled.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j, data, at in texts(batch):
                data = LOWER[data]
                starts, ends, first = words(data, at, ALNUM)
                raw = data.tobytes()
                rows = []
                for d in range(j - i):
                    own, a, n = raw[at[d] : at[d + 1]], first[d], int(first[d + 1] - first[d])
                    word = lambda p, a=a, d=d: int(np.searchsorted(starts, at[d] + p) - a)
                    found = [(word(m.start()), m.lastindex - 1) for m in base.finditer(own)] if b"license" in own else []
                    spans, text = [], None
                    for k, auto in compiled.items():
                        places = [word(m.start()) for m in anchors[k].finditer(own)] if auto.anchor[0].encode() in own else []
                        if places:
                            text = text or [raw[s:e].decode() for s, e in zip(starts[a : a + n].tolist(), ends[a : a + n].tolist(), strict=True)]
                            spans += [(s, e, k) for s, e in auto.find(text, places)]
                    covered = np.zeros(n + 1, np.int64)
                    for s, e in [(s, e) for s, e, _ in spans] + [(p, p + size[k]) for p, k in found]:
                        covered[s] += 1
                        covered[e] -= 1
                    labels = {names[k] for _, k in found}
                    at_words = [p for p, _ in found]
                    rows.append((n, len(found), min(at_words, default=None), max(at_words, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {k for _, _, k in spans})), float((np.cumsum(covered)[:n] > 0).mean()) if n else 0.0, ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans))))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
