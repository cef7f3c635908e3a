"""License scans: sparse TF-IDF cosine of notices and licence files to templates, then inheritance from directories.

Passages of a file are its lines, windows of consecutive lines about as long as a template (so wrapped notices are seen together) and the whole file.
Its cosine to a template is over words weighted by term count and inverse document frequency, and every word's frequency counts
all files.  Texts are read twice: once for the frequencies, once for the passages that can reach the threshold if every word outside the
templates is as common as can be; joins with the frequencies then settle their cosines.  A file's own licence is that of its best passage.  A licence file (by
its name, or nearly all of it one notice) licenses its directory.  A file without a notice inherits from the nearest directory
above it: paths are joined with directories, level by level, and the deepest hit is taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermark.llm.common import stored, temporary, text_or_empty

# Notices, headers, titles and whole short licences in common use, by SPDX identifier.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License."""],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-2.0-or-later": ["SPDX-License-Identifier: GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-3.0-or-later": ["SPDX-License-Identifier: GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""],
    "LGPL-3.0-only": ["This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-3.0-or-later": ["""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."""],
    "AGPL-3.0-only": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "AGPL-3.0-or-later": ["""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License.", """Redistribution and use in source and binary forms,
        with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related or neighboring rights."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""],
    "LicenseRef-Proprietary": ["All rights reserved.", "Proprietary and confidential."],
}
_TERM = re.compile(r"[a-z0-9]+")
_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.\-][a-z0-9.\-]*)?$"
_CANDIDATE = pa.struct([("whole", pa.bool_()), ("template", pa.int32()), ("dot", pa.float64()), ("square", pa.float64()), ("rest", pa.list_(pa.struct([("word", pa.string()), ("times", pa.int32())])))])


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class TemplateIndex:
    """Inverted lists from template words to templates, weighted for a corpus of n files of which frequency[w] hold w.

    `anchors` holds, for every template, its heaviest words until the rest of it is shorter than `least`: by the Cauchy-Schwarz
    inequality a passage without any of them has a smaller cosine than `least` to every template.
    """

    def __init__(self, frequency: dict[str, int], n: int, least: float, templates: dict[str, list[str]] = TEMPLATES):
        self.names = [name for name, texts in templates.items() for _ in texts]
        self.least, self.widest = least, math.log((1 + n) / 2) + 1  # the weight of a word that one file holds
        bags = [Counter(terms(t)) for texts in templates.values() for t in texts]
        self.idf = {w: math.log((1 + n) / (1 + frequency.get(w, 0))) + 1 for b in bags for w in b}
        self.lists: dict[str, list[tuple[int, float]]] = {}
        self.anchors: set[str] = set()
        for k, b in enumerate(bags):
            norm = math.sqrt(sum((c * self.idf[w]) ** 2 for w, c in b.items()))
            left = 1.0
            for w, c in sorted(b.items(), key=lambda x: (-x[1] * self.idf[x[0]], x[0])):
                weight = c * self.idf[w] / norm
                self.lists.setdefault(w, []).append((k, weight))
                if left >= least * least * (1 - 1e-9):
                    self.anchors.add(w)
                left -= weight * weight
        self.lengths: list[int] = []  # of windows, a quarter apart at least
        for size in sorted({sum(b.values()) for b in bags}):
            if not self.lengths or size > 1.25 * self.lengths[-1]:
                self.lengths.append(size)

    def passages(self, lines: list[list[str]]) -> set[tuple[int, int]]:
        """Spans of lines: each line, and from each line on as many as make up a template's length; those with an anchor only."""
        marked, size = [0], [0]
        for line in lines:
            marked.append(marked[-1] + (not self.anchors.isdisjoint(line)))
            size.append(size[-1] + len(line))
        spans = {(i, i + 1) for i in range(len(lines)) if marked[i + 1] > marked[i]}
        for length in self.lengths:
            end = 0
            for start in range(len(lines)):
                while end < len(lines) and size[end] - size[start] < length:
                    end += 1
                if marked[end] > marked[start]:
                    spans.add((start, end))
                if end == len(lines):
                    break
        return spans

    def score(self, words: list[str]) -> tuple[float, float, dict]:
        """Bounds of the best cosine, whatever files hold the words outside the templates, and what settles it (ties to the earlier template)."""
        square, dots, rest = 0.0, {}, []
        for w, c in Counter(words).items():
            if w not in self.idf:
                rest.append({"word": w, "times": c})
                continue
            weight = c * self.idf[w]
            square += weight * weight
            for k, t in self.lists[w]:
                dots[k] = dots.get(k, 0.0) + weight * t
        if not dots:
            return 0.0, 0.0, {}
        k = max(dots, key=lambda k: (dots[k], -k))
        others = sum(r["times"] ** 2 for r in rest)
        low, high = dots[k] / math.sqrt(square + others * self.widest**2), dots[k] / math.sqrt(square + others)
        return low, high, {"template": k, "dot": dots[k], "square": square, "rest": rest}

    def candidates(self, text: str) -> list[dict]:
        """The passages of a text that can be its best and reach `least`, and the whole text if it can."""
        if self.anchors.isdisjoint(terms(text)):
            return []
        lines = [words for words in map(terms, text.split("\n")) if words]
        floor = self.least * (1 - 1e-9)
        low, high, whole = self.score([w for words in lines for w in words])
        found = [whole | {"whole": True}] if high >= floor else []
        best, some = low, {}
        for start, end in self.passages(lines):
            words = [w for line in lines[start:end] for w in line]
            key = tuple(words)
            if key not in some and end - start < len(lines):
                some[key] = low, high, settled = self.score(words)
                best = max(best, low)
        edge = max(floor, best * (1 - 1e-9))
        return found + [settled | {"whole": False} for low, high, settled in some.values() if high >= edge]


def document_frequency(texts: DataFrame, text: str) -> DataFrame:
    """Columns word and n: the files that hold each word; counts are combined before the shuffle."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[a-z0-9]+"), F.lit(0)))
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def scan_files(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), least: float = 0.6, least_file: float = 0.6) -> DataFrame:
    """keep..., path, license (its own), similarity (0 below the thresholds), whole (cosine of the whole text, likewise), is_file (licence file).

    A null text is empty, a null path belongs to no directory; a text without words has similarity 0 and no licence; repeated rows
    each get their result, an empty table gives none.  Kept columns must not have the names of the result.
    """
    spark = files.sparkSession
    frequency = stored(document_frequency(files, text), "words")
    vocabulary = sorted({w for texts in TEMPLATES.values() for t in texts for w in terms(t)})
    n = files.count()
    of_templates = {r["word"]: r["n"] for r in frequency.where(F.col("word").isin(vocabulary)).collect()}  # as many as the templates have words
    names = TemplateIndex({}, n, least).names
    index = spark.sparkContext.broadcast(TemplateIndex(of_templates, n, min(least, least_file)))

    @F.arrow_udf("array<struct<whole: boolean, template: int, dot: double, square: double, rest: array<struct<word: string, times: int>>>>")
    def scan(texts: pa.Array) -> pa.Array:
        find = index.value.candidates
        return pa.array([find(t.as_py() or "") for t in texts], pa.list_(_CANDIDATE))

    row, cands = temporary("row", "cands")
    base = stored(files.select(*keep, F.col(path).alias("path"), F.monotonically_increasing_id().alias(row), scan(F.col(text).cast("string")).alias(cands)), "passages")
    each = base.where(F.size(cands) > 0).select(F.col(row).alias("row"), F.posexplode(cands).alias("at", "c"))
    weight = F.col("times") * (F.log((F.lit(1.0) + n) / (F.col("n") + 1)) + 1)
    rest = each.select("row", "at", F.inline("c.rest")).join(frequency, "word").groupBy("row", "at").agg(F.sum(weight * weight).alias("others"))
    cosine = F.least(F.lit(1.0), F.col("c.dot") / F.sqrt(F.col("c.square") + F.coalesce("others", F.lit(0.0))))
    settled = each.join(rest, ["row", "at"], "left").select("row", "c.whole", "c.template", F.round(cosine, 12).alias("cosine"))
    best = settled.groupBy("row").agg(F.max("cosine").alias("similarity"), F.min_by("template", F.struct(-F.col("cosine"), "template")).alias("template"), F.coalesce(F.max(F.when(F.col("whole"), F.col("cosine"))), F.lit(0.0)).alias("whole"))
    named = F.coalesce(F.col("path").rlike(_FILE), F.lit(False))
    license = F.when(F.col("similarity") >= least, F.element_at(F.array(*map(F.lit, names)), F.col("template") + 1))
    rows = base.join(best.select(F.col("row").alias(row), license.alias("license"), "similarity", "whole"), row, "left")
    reached = [F.when(F.col(c) >= min(least, least_file), F.col(c)).otherwise(0.0).alias(c) for c in ("similarity", "whole")]
    rows = rows.select(*keep, "path", "license", *reached)
    return rows.withColumn("is_file", F.col("path").isNotNull() & F.col("license").isNotNull() & (named | (F.col("whole") >= least_file)))


def inherit(scanned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep..., path, license (own, else of the nearest directory above), origin (own, inherited or none), from_dir, similarity.

    A directory with several licence files takes the licence of the most similar, then the first path."""
    base = stored(scanned, "licenses")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    dirs = stored(base.where("is_file").groupBy(folder.alias("dir")).agg(F.min_by("license", F.struct(-F.col("whole"), "path")).alias("dir_license")), "dirs")
    without = base.where("license IS NULL AND path IS NOT NULL").select("path").distinct()
    steps = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("dir")))
    found = without.select("path", F.inline(above)).join(dirs, "dir").groupBy("path").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("hit"))
    joined = base.join(stored(found, "inherited"), "path", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("hit").isNotNull(), "inherited").otherwise("none")
    from_dir = F.when(F.col("license").isNull(), F.col("hit.dir"))
    return joined.select(*keep, "path", F.coalesce("license", "hit.dir_license").alias("license"), origin.alias("origin"), from_dir.alias("from_dir"), "similarity")


def license_scan(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), **settings) -> DataFrame:
    """keep..., and the columns of `inherit`; a kept column named like one of those comes back with `file_` before its name."""
    inner = temporary(*keep)
    given = files.select(F.col(path).alias("path"), F.col(text).alias("text"), *[F.col(c).alias(t) for c, t in zip(keep, inner)])
    found = inherit(scan_files(given, keep=tuple(inner), **settings), tuple(inner))
    taken = [c for c in found.columns if c not in inner]
    return found.select(*[F.col(t).alias(f"file_{c}" if c in taken else c) for c, t in zip(keep, inner)], *taken)
