"""License scans: TF-IDF cosine of lines, runs of lines and whole files to templates, SPDX tags, and inheritance from the nearest
directory above.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.llm import text as T
from dealtide.llm.cluster import batches, merged, phased, stored
from dealtide.llm.lines import spans

#: Usual notices, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
    "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES += [
    ("MIT", f"MIT License {_GRANT} The above copyright notice and this permission notice shall be included in all copies "
     f"or substantial portions of the Software. {_AS_IS}"),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _THIRD + _BSD_AS_IS),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
     "rights to this work."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]
for _id, _name, _version, _date in (
    ("GPL-2.0", "GNU General Public License", "2", "June 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007"),
):
    _terms = (
        "is free software; you can redistribute it and/or modify it under the terms of the "
        f"{_name} as published by the Free Software Foundation"
    )
    _what = "This library" if _id[0] == "L" else "This program"
    _later = f"either version {_version} of the License, or (at your option) any later version."
    _without = (
        f" {_what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        f"{_name} for more details. You should have received a copy of the {_name} along with {_what.lower()}."
    )
    _or_later, _only = f"{_what} {_terms}; {_later}", f"{_what} {_terms}; version {_version} of the License only."
    TEMPLATES += [
        (f"{_id}-or-later", _or_later),
        (f"{_id}-or-later", _or_later + _without),
        (f"{_id}-only", _only),
        (f"{_id}-only", _only + _without),
        # The head of the licence itself, which doesn't say 'or later'.
        (f"{_id}-only", f"{_name} Version {_version}, {_date} Copyright (C) Free Software Foundation, Inc."),
    ]
#: Lines with a word in the longest run that is scored.
RUN = 32
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]*[A-Za-z0-9.+)])")
#: Licensed directories of more bytes than this aren't sent to the tasks.
SENT = 1 << 23
#: Names of files that license their directory, in lower case, without an extension.
LICENSE_FILES = ("license", "licence", "copying")


class _Vocabulary:
    """The templates' words, and each template's counts of them."""

    def __init__(self, templates: list[tuple[str, str]]):
        w = T.words(pa.array([t for _, t in templates]), T.NOT_ALNUM)
        h = w.hashes(lower=True)
        self.words = np.unique(h)
        self.counts = np.zeros((len(self.words), len(templates)))
        np.add.at(self.counts, (np.searchsorted(self.words, h), w.row), 1)

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word in the vocabulary, and whether it is there."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h


def _line_words(column: pa.Array) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, the line of each, and the row of each line."""
    w = T.words(column, T.NOT_ALNUM)
    _, start, _, row, _, _ = spans(column)
    return w, w.hashes(lower=True), np.searchsorted(start, w.start, "right") - 1, row


def _frequencies(texts: DataFrame, vocabulary: _Vocabulary) -> tuple[int, np.ndarray]:
    """The number of lines with a word, and of those with each word of the vocabulary, over all texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, h, line, _ = _line_words(batch.column("text"))
        at, known = vocabulary.known(h)
        n = len(vocabulary.words)
        pairs = np.unique(line[known] * n + at[known])
        keys, counts = np.unique(pairs % n, return_counts=True)
        return pa.record_batch(
            [
                pa.array(np.append(keys, -1)),
                pa.array(np.append(counts, len(np.unique(line)))),
            ],
            ["word", "n"],
        )

    rows = texts.mapInArrow(batches(run), "word bigint, n bigint").groupBy("word")
    counts = np.zeros(len(vocabulary.words))
    lines = 0
    for r in rows.agg(F.sum("n").alias("n")).collect():  # a row per word of the templates
        if r.word < 0:
            lines = r.n
        else:
            counts[r.word] = r.n
    return lines, counts


def _cosines(
    unit: np.ndarray,
    n: int,
    at: np.ndarray,
    known: np.ndarray,
    weight: np.ndarray,
    rare: float,
    norms: np.ndarray,
    templates: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """The best template of each unit (a line or a text) and its cosine; unit: of each word."""
    pairs, count = np.unique(unit[known] * len(weight) + at[known], return_counts=True)
    own, word = np.divmod(pairs, len(weight))
    value = count * weight[word]
    square = np.bincount(own, value**2, n) + np.bincount(unit[~known], minlength=n) * rare**2
    best, cosine = np.zeros(n, np.int64), np.zeros(n)
    for t in range(templates.shape[1]):
        dot = np.bincount(own, value * weight[word] * templates[word, t], n)
        c = dot / np.sqrt(np.maximum(square, 1e-12)) / norms[t]
        best[c > cosine] = t
        cosine = np.maximum(c, cosine)
    return best, cosine


def _runs(
    line: np.ndarray,
    row: np.ndarray,
    line_cosine: np.ndarray,
    threshold: float,
    at: np.ndarray,
    known: np.ndarray,
    weight: np.ndarray,
    rare: float,
    norms: np.ndarray,
    templates: np.ndarray,
) -> list[tuple[int, int, float]]:
    """(row, template, cosine) of runs of 2 to RUN lines with a word, the best of each stretch of them.

    Vectors of lines don't point away from each other, so a run of k lines that reaches the threshold
    has a line that reaches threshold / sqrt(k); only stretches around such lines are scored.
    """
    full, place = np.unique(line, return_inverse=True)
    row = row[full]
    seeds = np.flatnonzero(line_cosine[full] >= threshold / np.sqrt(RUN))
    out = []
    scaled = templates * weight[:, None] / norms
    ends = np.searchsorted(row, row[seeds], "right")
    starts = np.searchsorted(row, row[seeds], "left")
    low, high = np.maximum(seeds - RUN + 1, starts), np.minimum(seeds + RUN, ends)
    first = np.searchsorted(place, np.arange(len(full) + 1))
    i = 0
    while i < len(seeds):
        j = i
        # Seeds whose stretches meet are scored together, up to a size.
        while j + 1 < len(seeds) and low[j + 1] < high[j] and high[j + 1] - low[i] <= 16 * RUN and row[seeds[j + 1]] == row[seeds[i]]:
            j += 1
        a, b = low[i], high[j]
        words = slice(first[a], first[b])
        counts = np.zeros((b - a + 1, len(weight)))
        own, ok = place[words] - a + 1, known[words]
        np.add.at(counts, (own[ok], at[words][ok]), 1)
        counts = counts.cumsum(0) * weight
        others = np.bincount(own[~ok], minlength=b - a + 1).cumsum() * rare**2
        dots = counts @ scaled
        best = (0.0, 0)
        for k in range(2, min(RUN, b - a) + 1):
            square = ((counts[k:] - counts[:-k]) ** 2).sum(1) + others[k:] - others[:-k]
            c = (dots[k:] - dots[:-k]) / np.sqrt(np.maximum(square, 1e-12))[:, None]
            if c.max() > best[0]:
                best = float(c.max()), int(c.argmax() % c.shape[1])
        out.append((int(row[a]), best[1], best[0]))
        i = j + 1
    return out


@phased
def license_scan(
    files: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    threshold: float = 0.75,
) -> DataFrame:
    """(path, license, cosine, origin, directory): the license of every file; files: path, text.

    A file's own license is its first SPDX tag, as written, with cosine 1; else that of the template
    with the greatest cosine, of `threshold` at least, to one of its lines, to a run of up to RUN lines
    (those without a word don't count) or to its whole text: origin 'own'. Other files take that of the nearest
    directory at or above them with a licence file (LICENSE, LICENCE, COPYING, whatever the case and
    extension) that has one: origin 'inherited' and that directory; else 'none'.

    Weights are tf * idf over lines of all files, idf = ln((1 + lines) / (1 + lines with the word)).
    A word outside the templates weighs like one that no line has, each occurrence by itself. Words:
    runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Of several licence files in a
    directory the greatest cosine, then the least license, counts. Null texts are empty; a null path
    inherits nothing; repeated paths are rows like others. Other columns are ignored.
    """
    templates = templates or TEMPLATES
    names = [name for name, _ in templates]
    vocabulary = _Vocabulary(templates)
    rows = files.select("path", "text")
    lines, counts = _frequencies(rows.select("text"), vocabulary)
    weight = np.log((1 + lines) / (1 + counts)) + 1e-9
    rare = float(np.log(1 + lines)) + 1e-9
    norms = np.sqrt(((vocabulary.counts * weight[:, None]) ** 2).sum(0))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, h, line, row = _line_words(batch.column("text"))
        at, known = vocabulary.known(h)
        args = at, known, weight, rare, norms, vocabulary.counts
        best, cosine = _cosines(w.row, len(batch), *args)
        of_line, line_cosine = _cosines(line, len(row), *args)
        order = np.lexsort((-line_cosine, row))
        first = order[np.searchsorted(row[order], np.arange(len(batch)))]
        better = line_cosine[first] > cosine
        best, cosine = np.where(better, of_line[first], best), np.maximum(line_cosine[first], cosine)
        for r, t, c in _runs(line, row, line_cosine, threshold, *args):
            if c > cosine[r]:
                best[r], cosine[r] = t, c
        found = cosine >= threshold
        own = [names[b] if f else None for b, f in zip(best, found, strict=True)]
        texts = batch.column("text")
        for r in np.flatnonzero(pc.match_substring(texts, "SPDX-License-Identifier:").fill_null(False)):
            tag = _SPDX.search(texts[int(r)].as_py())
            if tag:
                own[r], cosine[r], found[r] = tag[1], 1.0, True
        return pa.record_batch(
            [
                batch.column("path"),
                pa.array(own, pa.string()),
                pa.array(np.where(found, np.round(cosine, 6), 0.0)),
            ],
            ["path", "license", "cosine"],
        )

    scanned = stored(rows.mapInArrow(batches(run), "path string, license string, cosine double"))
    scanned = scanned.withColumn("directory", F.expr("regexp_replace(path, '/?[^/]*$', '')"))
    name = "split_part(lower(regexp_extract(path, '([^/]*)$', 1)), '.', 1)"
    licensed = stored(
        scanned.where(f"license is not null and {name} in {LICENSE_FILES}")
        .groupBy("directory")
        .agg(F.min(F.struct(-F.col("cosine"), F.col("license"))).alias("best"))
        .select(F.col("directory").alias("above"), F.col("best.license").alias("inherited"))
    )
    size = licensed.agg(F.sum(F.octet_length("above") + F.octet_length("inherited") + 64)).first()[0] or 0
    # Directories, not files, are joined with those above them.
    directories = scanned.where("path is not null").select("directory").distinct()
    above = directories.selectExpr(
        "directory",
        "explode(transform(sequence(0, size(split(directory, '/'))), "
        "i -> array_join(slice(split(directory, '/'), 1, i), '/'))) as above",
    )
    nearest = (
        above.distinct()
        .join(F.broadcast(licensed) if size <= SENT else merged(licensed), "above")
        .groupBy("directory")
        .agg(F.max_by(F.struct("above", "inherited"), F.length("above")).alias("nearest"))
    )
    own = F.col("license").isNotNull()
    return scanned.join(merged(nearest), "directory", "left").select(
        "path",
        F.coalesce("license", "nearest.inherited").alias("license"),
        "cosine",
        F.when(own, "own").when(F.col("nearest").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("nearest.above")).alias("directory"),
    )


def documents_as_files(documents: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / block of 400 / block of 20 / name. Every fifth is a
    LICENSE, of its block of 400 if divisible by 100, else of its block of 20.
    """
    number = "cast(doc_id as bigint)"
    return documents.selectExpr(
        f"concat_ws('/', coalesce(source, 'unknown'), {number} div 400, "
        f"if({number} % 100 = 0, null, {number} div 20), "
        f"if({number} % 5 = 0, concat('LICENSE.', doc_id), concat(doc_id, '.txt'))) as path",
        "text",
    )
