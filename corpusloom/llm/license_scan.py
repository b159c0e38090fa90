"""License scans: texts compared to licence templates by the Dice coefficient of their word bigrams.

Text is normalised to lower-case runs of ASCII letters and digits, with dots inside numbers; line ends, comment marks and other signs only part
words. For a template of k words every run of k words of the text is a span (of a shorter text, the whole), so that a notice is found
wherever it stands. A span of a distinct bigrams and a template of b can reach Dice t only if t / (2 - t) * b <= a <= (2 - t) / t * b, and only
if they share t / (2 - t) * b: templates of which the text has fewer bigrams aren't compared.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import python_ready

THRESHOLD = 0.8
#: Paragraphs of licence texts, as their publishers word them.
_MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
_ISC = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
]
_ZLIB = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "3. This notice may not be removed or altered from any source distribution.",
]
_UNLICENSE = [
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
]
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
#: Notices by which works name their licence.
_NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Released under the BSD License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("bsd-2-clause", "This project is licensed under the BSD 2-Clause License."),
    ("bsd-3-clause", "This project is licensed under the BSD 3-Clause License."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
]
#: Whole licence texts, their paragraphs that no other licence has, and notices.
TEMPLATES = [
    ("mit", " ".join(_MIT)),
    ("bsd-2-clause", " ".join(_BSD[i] for i in (0, 1, 2, 4))),
    ("bsd-3-clause", " ".join(_BSD)),
    ("isc", " ".join(_ISC)),
    ("zlib", " ".join(_ZLIB)),
    ("unlicense", " ".join(_UNLICENSE)),
    ("bsl-1.0", _BOOST),
    ("mit", _MIT[0]),
    ("mit", _MIT[1]),
    ("bsd", _BSD[0]),
    ("isc", _ISC[0]),
    ("zlib", _ZLIB[1]),
    ("unlicense", _UNLICENSE[0]),
    *_NOTICES,
]
_WORD = re.compile(rb"[0-9a-z]+(?:\.[0-9]+)*")
Bigrams = frozenset[tuple[bytes, bytes]]


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def bigrams(words: list[bytes]) -> Bigrams:
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        self.threshold, self.ratio = threshold, (2 - threshold) / threshold
        listed = [(name, words_of(text)) for name, text in templates]
        #: (name, words, bigrams) of each template with a bigram
        self.templates = [(name, len(w), bigrams(w)) for name, w in listed if len(w) > 1]
        self.having: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (_, _, bag) in enumerate(self.templates):
            for b in bag:
                self.having.setdefault(b, []).append(i)

    def best(self, words: list[bytes], size: int, bag: Bigrams) -> tuple[float, int]:
        """The highest Dice of a template with the runs of `size` of these words, and where the first such run begins: bigrams come and go one at a time."""
        pairs = list(zip(words, words[1:], strict=False))
        seen, top, at = Counter(pairs[: size - 1]), 0.0, 0
        shared = sum(b in bag for b in seen)
        for i in range(max(1, len(pairs) - size + 2)):
            if i:
                old, new = pairs[i - 1], pairs[i + size - 2]
                seen[old] -= 1
                if not seen[old]:
                    del seen[old]
                    shared -= old in bag
                if new not in seen:
                    shared += new in bag
                seen[new] += 1
            if len(seen) <= len(bag) * self.ratio and len(bag) <= len(seen) * self.ratio:
                dice = 2 * shared / (len(seen) + len(bag))
                if dice > top:
                    top, at = dice, i
        return top, at

    def hits(self, text: str) -> list[tuple[float, str]]:
        """(Dice, name) of each template that reaches the threshold somewhere in the text, unless one that does better there overlaps its span."""
        words = words_of(text)
        mine = set(zip(words, words[1:], strict=False))
        common = mine & self.having.keys()
        shared = Counter(i for b in common for i in self.having[b])
        found = []
        for i, n in sorted(shared.items()):
            name, size, bag = self.templates[i]
            if n * self.ratio >= len(bag):
                dice, at = self.best(words, size, bag)
                if dice >= self.threshold:
                    found.append((-dice, i, at, at + size, name))
        return [(-a[0], a[4]) for a in found if not any(b[:2] < a[:2] and b[2] < a[3] and a[2] < b[3] for b in found)]


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_hits, licenses, best_license, best_dice.

    n_hits counts the templates that some span of the text matches, best of those that overlap (of equals the first listed); licenses are
    their names, distinct, in order, with commas. Without
    hits (and for null or empty texts) n_hits is 0, licenses empty, best_license null and best_dice 0. Of equal Dice the first name counts.
    Templates of fewer than two words match nothing. Repeated rows come out alike; other columns are ignored. Long texts are scanned whole.
    """
    python_ready(docs.sparkSession)
    scanner = Scanner(TEMPLATES if templates is None else templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, names, best, dice = [], [], [], []
            for t in b.column("text"):
                hits = scanner.hits(t.as_py() or "")
                top = min(hits, key=lambda h: (-h[0], h[1]), default=(0.0, None))
                n.append(len(hits)), names.append(",".join(sorted({h[1] for h in hits}))), best.append(top[1]), dice.append(top[0])
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_hits": pa.array(n, pa.int64()), "licenses": pa.array(names, pa.string()), "best_license": pa.array(best, pa.string()), "best_dice": pa.array(dice, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_hits long, licenses string, best_license string, best_dice double")


def license_sql(templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for license_scan over the table documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(TEMPLATES if templates is None else templates))
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+(?:\.[0-9]+)*')"
    pairs = "list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda x: x[1] || ' ' || x[2])"
    ratio = repr((2 - threshold) / threshold)
    return rf"""
WITH templates(tid, name, text) AS (VALUES {rows}),
t AS (SELECT tid, name, len(w) AS size, list_distinct({pairs}) AS bag FROM (SELECT tid, name, {words.format('text')} AS w FROM templates) WHERE len(w) > 1),
tb AS (SELECT tid, len(bag) AS b, unnest(bag) AS pair FROM t),
d AS (SELECT row_number() OVER () AS did, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT did, {pairs} AS all_pairs FROM d WHERE len(w) > 1),
near AS (
  SELECT p.did, tb.tid FROM (SELECT did, unnest(list_distinct(all_pairs)) AS pair FROM p) p JOIN tb USING (pair)
  GROUP BY p.did, tb.tid HAVING count(*) * {ratio} >= max(tb.b)
),
spans AS (
  SELECT p.did, t.tid, t.name, t.size, t.bag, i, list_distinct(list_slice(p.all_pairs, i, i + t.size - 2)) AS span
  FROM near JOIN p USING (did) JOIN t USING (tid), LATERAL (SELECT unnest(range(1, greatest(1, len(p.all_pairs) - t.size + 2) + 1)) AS i)
),
dice AS (
  SELECT did, tid, name, size, i, 2 * len(list_intersect(span, bag)) / (len(span) + len(bag)) AS dice FROM spans
  WHERE len(span) <= len(bag) * {ratio} AND len(bag) <= len(span) * {ratio}
),
found AS (SELECT * FROM dice WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY did, tid ORDER BY dice DESC, i) = 1),
best AS (
  SELECT * FROM found a WHERE NOT EXISTS (
    SELECT 1 FROM found b WHERE b.did = a.did AND (b.dice > a.dice OR (b.dice = a.dice AND b.tid < a.tid)) AND b.i < a.i + a.size AND a.i < b.i + b.size)
)
SELECT d.doc_id, count(best.tid) AS n_hits, coalesce(string_agg(DISTINCT best.name, ',' ORDER BY best.name), '') AS licenses,
       first(best.name ORDER BY best.dice DESC, best.name) AS best_license, coalesce(max(best.dice), 0.0) AS best_dice
FROM d LEFT JOIN best ON best.did = d.did GROUP BY d.did, d.doc_id
"""
