"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them (operator 4).

Texts and templates become words and shingles of `WIDTH` words. A template of s shingles belongs to the class c, the
smallest power of two of at least s (and 4). Windows of class c are 2c shingles long and start every c shingles, so every
stretch of c shingles lies whole in some window. Each window and template has `BANDS` MinHash values, one a band; a
window retrieves each template of its class that shares a band. With containment t of the template, their Jaccard
similarity is at least t*s / (2c + (1 - t)*s), and s > c/2: at t = 0.8 that is 0.19, so a match is missed with
probability under (1 - 0.19) ** 48 < 5e-5; whole copies (0.25) with 1e-6. (Templates of one or two shingles are of class
4 too, with a similarity of at least 1/8: under 2e-3.) A window's minima come from its two halves, and a class's from
the class below, so each band costs one pass over the words.

A retrieved template is looked for in its window and the class's length around it: a match is a stretch of at most
`REACH` c shingles that holds at least `containment` of the template's distinct shingles, compared word by word, and
ends where a shingle comes more often than the template has it, so copies one after another are matches of their own. A
stretch with another version's digits where the template has its own is another license. Licenses resemble each other:
of matches that have half of the smaller one's shingles in the text in common, the one with the most matched shingles
stays (then the greater containment, then the first id), so a notice of one license isn't reported as its sibling's or as
its own opening's. The templates are a parameter, shipped whole, of a size that `MAX_TEMPLATE_WORDS` bounds.

Defined results: null and empty texts match nothing; texts under WIDTH words match nothing; repeated templates' ids
count as one, under the first of them; templates under WIDTH words are refused; repeated rows get equal results; an empty
table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.decontaminate import words_of

WIDTH, BANDS, MAX_TEMPLATE_WORDS = 3, 48, 1_000_000
#: The notices and texts by which works state their license.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-1.0-notice": "Released under CC0 1.0 Universal.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mit": "Released under the MIT License.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_later = ", or (at your option) any later version"
_advert = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither"
TEMPLATES |= {
    "gpl-2.0-only-header": TEMPLATES["gpl-2.0-header"].replace("either version 2", "version 2").replace(_later, ""),
    "gpl-3.0-only-header": TEMPLATES["gpl-3.0-header"].replace("either version 3", "version 3").replace(_later, ""),
    "lgpl-2.0-header": TEMPLATES["lgpl-2.1-header"].replace("Lesser", "Library").replace("version 2.1", "version 2"),
    "bsd-4-clause": TEMPLATES["bsd-3-clause"].replace("3. Neither", _advert),
    "gfdl-1.3-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    **{k.removesuffix("-notice").replace("4.0", "3.0-notice"): v.replace("4.0 International", "3.0 Unported") for k, v in TEMPLATES.items() if v.endswith("4.0 International License.")},
}
REACH = 4
_rng = np.random.default_rng(20)
MULTIPLY = (_rng.integers(1, 1 << 32, BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = _rng.integers(0, 1 << 32, BANDS, dtype=np.uint64).astype(np.uint32)


def shingle_keys(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    w = np.empty(len(words), np.uint32)
    for i, x in enumerate(words):
        h = memo.get(x)
        if h is None:
            if len(memo) > 200_000:
                memo.clear()
            h = memo[x] = crc32(x)
        w[i] = h
    n = len(words) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    h = np.zeros(n, np.uint32)
    for k in range(WIDTH):
        h = h * np.uint32(0x9E3779B1) + w[k : k + len(h)]
        h ^= h >> np.uint32(15)
    return h


def version_of(name: str, words: list[bytes]) -> tuple[bytes, ...] | None:
    """The phrase that tells a template's version: the word before the digits of its name, where its text has them, and
    the digits there."""
    version = re.search(r"-([0-9]+)\.[0-9]+", name)
    for i in range(1, len(words) if version else 0):
        if words[i] == version[1].encode() and not words[i - 1].isdigit():
            return tuple(words[i - 1 : next((k for k in range(i, len(words)) if not words[k].isdigit()), len(words))])
    return None


def contradicts(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    """Whether words have other digits after the phrase's first word, and nowhere those of the phrase."""
    found = set()
    for i, w in enumerate(words):
        if w == phrase[0]:
            end = next((k for k in range(i + 1, len(words)) if not words[k].isdigit()), len(words))
            found.add(tuple(words[i:end]))
    return phrase not in found and any(len(x) > 1 for x in found)


def copies(held: list[tuple[int, tuple]], own: Counter, need: float, reach: int) -> list[tuple[int, int, int, set[int]]]:
    """(first place, last place, distinct shingles, places) of the matches among a template's shingles at their places."""
    out: list[tuple[int, int, int, set[int]]] = []
    waiting: deque[tuple[int, tuple]] = deque()
    count: Counter = Counter()
    start, taken, last = None, [], 0

    def close() -> None:
        nonlocal start
        if start is not None:
            out.append((start, last, len(count), set(taken)))
            start = None
            count.clear()

    for k, g in held:
        if start is not None and count[g] < own[g] and k - start <= reach:
            count[g] += 1
            taken.append(k)
            last = k
            continue
        close()
        waiting.append((k, g))
        count[g] += 1
        while k - waiting[0][0] > reach or count[waiting[0][1]] > own[waiting[0][1]]:
            count[waiting.popleft()[1]] -= 1
        count += Counter()
        if len(count) >= need:
            start, taken, last = waiting[0][0], [x for x, _ in waiting], k
            waiting.clear()
    close()
    return out


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.sets: dict[str, set[tuple]] = {}
        self.counts: dict[str, Counter] = {}
        self.version: dict[str, tuple[bytes, ...] | None] = {}
        self.tables: dict[int, list[tuple[np.ndarray, list[list[str]]]]] = {}
        self.common: dict[int, np.ndarray] = {}
        by_class: dict[int, list[tuple[str, np.ndarray]]] = {}
        for name, text in texts.items():
            words = words_of(text.encode())
            if len(words) < WIDTH:
                raise ValueError(f"template {name} has under {WIDTH} words")
            self.counts[name] = Counter(tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1))
            self.sets[name] = set(self.counts[name])
            self.version[name] = version_of(name, words)
            c = max(4, 1 << (len(self.sets[name]) - 1).bit_length())
            h = shingle_keys(words, {})
            by_class.setdefault(c, []).append((name, (h[None, :] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1)))
        for c, own in by_class.items():
            self.tables[c] = []
            for b in range(BANDS):
                named: dict[int, list[str]] = {}
                for name, mins in own:
                    named.setdefault(int(mins[b]), []).append(name)
                values = np.array(sorted(named), np.uint32)
                self.tables[c].append((values, [named[int(v)] for v in values]))
        self.classes = sorted(self.tables)


def retrieve(h: np.ndarray, t: Templates) -> set[tuple[int, int, str]]:
    """(start, class, template) of windows that share a band with a template, over keys whose number is a multiple of
    the largest class."""
    out = set()
    for b in range(BANDS):
        x = h * MULTIPLY[b] + ADD[b]
        mins = np.minimum(np.minimum(x[::4], x[1::4]), np.minimum(x[2::4], x[3::4]))
        c = 4
        while True:
            if c in t.tables:
                values, names = t.tables[c][b]
                both = np.minimum(mins, np.r_[mins[1:], mins[-1:]])
                at = np.searchsorted(values, both)
                hit = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == both)
                for i in hit.tolist():
                    for name in names[at[i]]:
                        out.add((i * c, c, name))
            if c >= t.classes[-1]:
                break
            c *= 2
            mins = np.minimum(mins[::2], mins[1::2])
    return out


def scan(texts: list[bytes], t: Templates, containment: float, memo: dict[bytes, int]) -> list[list[tuple[str, int, int, float]]]:
    """For each text (template, first word, end word, containment) of each stretch that holds a template, by start.

    The texts' keys stand in one array, each padded with its last key to a multiple of the largest class, so that no
    block has keys of two texts; a window that reaches into the next text is cut at its own text's end.
    """
    top = t.classes[-1]
    words = [words_of(x) for x in texts]
    keys = [shingle_keys(w, memo) for w in words]
    padded = [np.r_[k, np.full(-len(k) % top, k[-1], np.uint32)] for k in keys if len(k)]
    which = [i for i, k in enumerate(keys) if len(k)]
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    if not padded:
        return out
    starts = np.cumsum([0, *map(len, padded)])
    met: dict[int, list[tuple[str, int, int, int]]] = {}
    for at, c, name in retrieve(np.concatenate(padded), t):
        k = int(np.searchsorted(starts, at, "right")) - 1
        a, n = at - int(starts[k]), len(keys[which[k]])
        if a < n:
            met.setdefault(which[k], []).append((name, max(0, a - c), min(n, a + 3 * c), c))
    for i, windows in met.items():
        found = []
        for name, a, b, c in joined_windows(windows):
            own = t.counts[name]
            held = [(k, g) for k in range(a, b) if (g := tuple(words[i][k : k + WIDTH])) in own]
            for first, last, n, at in copies(held, own, containment * len(own), REACH * c):
                end = last + WIDTH
                if t.version[name] is None or not contradicts(words[i][first : end + 2], t.version[name]):
                    found.append((name, first, end, n, n / len(own), at))
        out[i] = best_of(found)
    return out


def joined_windows(windows: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """The windows of each template, those that meet as one."""
    out: list[tuple[str, int, int, int]] = []
    for name, a, b, c in sorted(windows):
        if out and out[-1][0] == name and a <= out[-1][2]:
            out[-1] = (name, out[-1][1], max(b, out[-1][2]), c)
        else:
            out.append((name, a, b, c))
    return out


def best_of(matches: list[tuple[str, int, int, int, float, set[int]]]) -> list[tuple[str, int, int, float]]:
    """The matches that no better one covers, by start: none whose shingles are half of the smaller one's."""
    kept, taken = [], defaultdict(list)
    for name, a, b, _, share, at in sorted(matches, key=lambda m: (-m[3], -m[4], m[0], m[1])):
        both = Counter(k for p in at for k in taken[p])
        if not any(2 * n >= min(len(at), kept[k][4]) for k, n in both.items()):
            for p in at:
                taken[p].append(len(kept))
            kept.append((a, name, b, share, len(at)))
    return [(name, a, b, share) for a, name, b, share, _ in sorted(kept)]


def groups_of(texts: list[bytes], most: int = 1 << 22):
    """The texts in runs of about `most` bytes."""
    at = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_matches, licenses (sorted ids), spans (id:first word:end word) and best containment for each row."""
    texts = TEMPLATES if templates is None else templates
    if sum(len(x.split()) for x in texts.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates exceed MAX_TEMPLATE_WORDS")

    def run(batches):
        t, memo = Templates(texts), {}
        for batch in batches:
            own = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = [r for g in groups_of(own) for r in scan(g, t, containment, memo)]
            cols = [
                pa.array(list(map(len, rows)), pa.int64()),
                pa.array([",".join(sorted({m[0] for m in r})) for r in rows], pa.string()),
                pa.array([",".join(f"{n}:{a}:{b}" for n, a, b, _ in r) for r in rows], pa.string()),
                pa.array([max((m[3] for m in r), default=0.0) for r in rows], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_matches", "licenses", "spans", "containment"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_matches bigint, licenses string, spans string, containment double")
