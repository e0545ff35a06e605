"""License scans: winnowed fingerprints pick templates, banded alignment measures the match."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM_WORDS = 3
WINDOW = 3  # with the grams: any shared run of GRAM_WORDS + WINDOW - 1 words shares a fingerprint
BAND = 8  # words that may be inserted or left out on the way
MIN_COVERAGE = 0.8

# Notices and texts of public licenses.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed-line": "Licensed under the MIT License.",
    "BSD-line": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
        "more details."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means."
    ),
}



def _gnu(kind: str, version: str, subject: str = "program", or_later: bool = True) -> str:
    """Notice of a GNU license; its relatives differ by a few words."""
    terms = f"either version {version} of the License, or (at your option) any later version."
    published = "as published by the Free Software Foundation"
    return (
        f"This {subject} is free software: you can redistribute it and/or modify it under the terms of "
        + (f"the GNU {kind} {published}, {terms}" if or_later else f"the GNU {kind} version {version} {published}.")
        + f" This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {kind} for more details."
    )


_GPL, _LGPL, _AGPL = (f"{x}General Public License" for x in ("", "Lesser ", "Affero "))
_CC = "This work is licensed under a Creative Commons Attribution-{} 4.0 International License."

# Close relatives, so that the one of more matched words takes a text, not the only one.
TEMPLATES |= {
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "BSD-2-Clause-line": "Licensed under the BSD 2-Clause License.",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-ND-long": _CC.format("NoDerivatives"),
    "CC-BY-NC-SA-long": _CC.format("NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-long": _CC.format("NonCommercial-NoDerivatives"),
    "GPL-2.0-or-later-notice": _gnu(_GPL, "2"),
    "GPL-2.0-only-notice": _gnu(_GPL, "2", or_later=False),
    "GPL-3.0-only-notice": _gnu(_GPL, "3", or_later=False),
    "AGPL-3.0-notice": _gnu(_AGPL, "3"),
    "LGPL-2.1-notice": _gnu(_LGPL, "2.1", "library"),
    "LGPL-3.0-notice": _gnu(_LGPL, "3"),
    "LGPL-3.0-library-notice": _gnu(_LGPL, "3", "library"),
    "BSD-3-Clause": TEMPLATES["BSD-2-Clause"]
    + " Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission.",
}

_WORD = re.compile(r"\w+")


class Match(NamedTuple):
    template: str
    start: int  # code points
    end: int
    matched: int  # words
    coverage: float  # of the template's words


class Index:
    """Vocabulary and winnowed fingerprints of all templates; its size is that of the templates."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM_WORDS, window: int = WINDOW):
        self.gram, self.window = gram, window
        self.vocabulary: dict[str, int] = {}
        self.names = sorted(templates)
        self.words = []
        for name in self.names:
            tokens = _WORD.findall(templates[name].lower())
            self.words.append(
                [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens]
            )
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for at, h in self.fingerprints(np.array(words, dtype=np.uint64)):
                self.postings.setdefault(h, []).append((t, at))

    def fingerprints(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """``(position, hash)`` of the smallest gram in each window; grams with unknown words never win."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return []
        h = np.zeros(n, dtype=np.uint64)
        known = np.ones(n, dtype=bool)
        for i in range(self.gram):
            part = ids[i : i + n]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            known &= part > 0
        if not known.any():
            return []
        h[~known] = np.uint64(0xFFFFFFFFFFFFFFFF)
        width = min(self.window, n)
        lowest = np.lib.stride_tricks.sliding_window_view(h, width).argmin(axis=1)
        picked = np.unique(lowest + np.arange(n - width + 1))
        return [(int(p), int(h[p])) for p in picked if known[p]]


def align(words: list[int], ids: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment of a template with a text near a diagonal: matched words and their span.

    The text's word opposite template word ``i`` is ``i + diagonal``, give or take ``band``. A match
    scores 2, a change or gap costs 1. Returns ``(matched, first, last)`` by text position.
    """
    width = 2 * band + 1
    empty = (0, 0, -1, -1)  # score, matched, first, last
    best = empty
    above = [empty] * width
    n = len(ids)
    for i, word in enumerate(words):
        row = [empty] * width
        left = empty
        for k in range(width):
            j = i + diagonal + k - band
            if 0 <= j < n:
                s, m, first, last = above[k]
                if ids[j] == word:
                    cell = (s + 2, m + 1, first if m else j, j)
                else:
                    cell = (s - 1, m, first, last)
                if k + 1 < width and above[k + 1][0] - 1 > cell[0]:
                    s, m, first, last = above[k + 1]
                    cell = (s - 1, m, first, last)
                if left[0] - 1 > cell[0]:
                    s, m, first, last = left
                    cell = (s - 1, m, first, last)
                if cell[0] <= 0:
                    cell = empty
                row[k] = left = cell
                if cell > best and cell[0] > best[0]:
                    best = cell
            else:
                left = empty
        above = row
    return best[1:]


def find_licenses(
    text: str | None, index: Index, min_coverage: float = MIN_COVERAGE, band: int = BAND
) -> list[Match]:
    """Templates found in a text, by place. Of matches that overlap, the one of more words stays."""
    places, ids = [], []
    get = index.vocabulary.get
    for m in _WORD.finditer(text or ""):
        ids.append(get(m.group().lower(), 0))
        places.append(m)
    ids = np.array(ids, dtype=np.uint64)
    seeds: dict[int, dict[int, list[int]]] = {}
    for at, h in index.fingerprints(ids):
        for t, own in index.postings.get(h, ()):
            seeds.setdefault(t, {}).setdefault(at - own, []).append(at)
    found = []
    for t, diagonals in seeds.items():
        words = index.words[t]
        width = min(band, max(1, len(words) // 4))  # a strip that holds one copy of the template
        settled = bytearray(len(ids))
        for d in sorted(diagonals, key=lambda x: (-len(diagonals[x]), x)):
            if all(settled[p] for p in diagonals[d]):
                continue  # its fingerprints lie in matches found before
            matched, first, last = align(words, ids, d, width)
            coverage = matched / len(words)
            if coverage >= min_coverage:
                settled[first : last + 1] = b"\1" * (last + 1 - first)
                found.append(
                    Match(index.names[t], places[first].start(), places[last].end(), matched, round(coverage, 6))
                )
    found.sort(key=lambda x: (-x.matched, -x.coverage, x.start, x.template))
    # Kept matches are apart, so one ordered list of their bounds settles each further one.
    kept: list[Match] = []
    starts: list[int] = []
    ends: list[int] = []
    for x in found:
        i = bisect_right(starts, x.start)
        if (i and ends[i - 1] > x.start) or (i < len(starts) and starts[i] < x.end):
            continue
        starts.insert(i, x.start)
        ends.insert(i, x.end)
        kept.append(x)
    return sorted(kept, key=lambda x: (x.start, x.template))


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    min_coverage: float = MIN_COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_licenses, licenses, matches`` of every row.

    ``matches`` is an array of ``(template, start, end, matched, coverage)`` in code points, words and
    parts of the template's words; ``licenses`` joins the distinct templates by comma. Null and
    empty texts have none. Null identifiers and repeated rows come back as they came in; other
    columns are ignored. Texts are scanned whole, each in its row, so nothing is shuffled.
    """
    index = Index(TEMPLATES if templates is None else templates)
    kind = pa.struct(
        [("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]
    )

    def run(batches):
        for batch in batches:
            found = [find_licenses(t.as_py(), index, min_coverage) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([",".join(sorted({m.template for m in x})) for x in found], pa.string()),
                    pa.array([[m._asdict() for m in x] for x in found], pa.list_(kind)),
                ],
                names=[id_col, "n_licenses", "licenses", "matches"],
            )

    given = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run,
        f"`{id_col}` {given}, n_licenses bigint, licenses string, matches array<struct<template:string,"
        "start:bigint,end:bigint,matched:bigint,coverage:double>>",
    )
