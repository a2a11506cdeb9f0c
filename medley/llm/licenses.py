"""License scans by patience alignment of texts with license templates.

A stretch of a text that shares enough words with a template is aligned with it:
words that occur once in both are anchors, the longest increasing run of anchors
is kept, and the gaps between them are aligned the same way; where a gap has no
such word, equal words at its two ends still match.  The coverage of a template is
the share of its words that were matched.

Every stretch is found by counting: a window can only reach a coverage if it holds
that share of the template's words, so other windows are passed over in linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
COVERAGE = 0.8
STRETCH = 1.5  # window length in template lengths: inserted words may make a copy longer than its template

#: Opening notices and permission texts of common licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-full": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-full": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-2-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "All-rights-reserved": "All rights reserved.",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This work is licensed under the Mozilla Public License, version 2.0.",
    "BSD": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "MPL-2.0-full": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-3-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
}

_GPL = TEMPLATES["GPL-3.0-full"]
TEMPLATES |= {
    "GPL-2.0-full": _GPL.replace("version 3", "version 2"),
    "LGPL-2.1-full": _GPL.replace("version 3", "version 2.1").replace("General", "Lesser General"),
    "LGPL-3.0-full": _GPL.replace("General", "Lesser General"),
    "AGPL-3.0-full": _GPL.replace("General", "Affero General"),
}

#: Words that tell a notice from those of sibling licenses and versions; all must be matched.
NAMING = {
    "MIT": "mit",
    "Apache-2.0": "apache 2.0",
    "Apache-1.1": "apache 1.1",
    "GPL-3.0-full": "3",
    "GPL-2.0-full": "2",
    "LGPL-2.1-full": "2.1",
    "LGPL-3.0-full": "3",
    "AGPL-3.0-full": "3",
    "GPL-3.0": "gnu general 3",
    "GPL-2.0": "gnu general 2",
    "LGPL-2.1": "gnu lesser 2.1",
    "LGPL-3.0": "gnu lesser 3",
    "AGPL-3.0": "gnu affero 3",
    "MPL-2.0": "mozilla 2.0",
    "BSD": "bsd",
    "CC-BY-NC-4.0": "cc by-nc 4.0",
    "CC-BY-4.0": "cc by 4.0",
    "CC-BY-SA-4.0": "cc by-sa 4.0",
    "CC-BY-ND-4.0": "cc by-nd 4.0",
    "CC-BY-NC-SA-4.0": "cc by-nc-sa 4.0",
    "CC-BY-NC-ND-4.0": "cc by-nc-nd 4.0",
}


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing run of ``values``, by piles as in patience."""
    tops: list[int] = []
    top_index: list[int] = []
    behind = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            top_index.append(i)
        else:
            tops[pile], top_index[pile] = value, i
        behind[i] = top_index[pile - 1] if pile else -1
    out, i = [], top_index[-1] if top_index else -1
    while i >= 0:
        out.append(i)
        i = behind[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, increasing in both."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if there[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if here[w] == 1 and w in place]
        kept = [anchors[i] for i in increasing([j for _, j in anchors])]
        if not kept:
            continue
        matched += kept
        for (i, j), (k, m) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(matched)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.templates = {name: [m[0].lower() for m in WORD.finditer(text)] for name, text in templates.items()}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.coverage = coverage
        self.users: dict[str, list[str]] = {}
        for name, count in self.counts.items():
            for word in count:
                self.users.setdefault(word, []).append(name)
        shared = Counter(w for count in self.counts.values() for w in count)
        # a window that reaches the coverage must hold one of these: the template's words that fewest
        # templates use, so many that the others alone fall short
        self.keys: dict[str, list[str]] = {}
        for name, count in self.counts.items():
            rest = len(self.templates[name])
            for word in sorted(count, key=lambda w: (shared[w], -len(w), w)):
                if rest < coverage * len(self.templates[name]):
                    break
                rest -= count[word]
                self.keys.setdefault(word, []).append(name)

        self.naming = {
            name: {i for i, w in enumerate(words) if w in NAMING[name].split()}
            for name, words in self.templates.items()
            if name in NAMING and templates[name] == TEMPLATES[name]
        }

    def copies(self, lower: list[str], places: list[tuple[int, str]], name: str) -> Iterator[list[tuple[int, int]]]:
        """Alignments of the template's copies, from left to right.  ``places``: (place, word) of its
        words in the text.  Once a window holds enough of them it is aligned; the search goes on
        behind a copy, or a little further where there was none."""
        template, count = self.templates[name], self.counts[name]
        size = len(template)
        need = self.coverage * size
        reach = int(STRETCH * size) + 2
        beyond = int(STRETCH * (size - need)) + 2  # the rest of a copy, from where it is noticed
        inside: Counter = Counter()
        held = first = last = 0
        while last < len(places):
            place, word = places[last]
            inside[word] += 1
            held += inside[word] <= count[word]
            last += 1
            keep_from = place - reach + 1
            if held >= need:
                begin = max(places[first][0], keep_from)
                pairs = align(lower[begin : place + beyond], template)
                if len(pairs) >= need:
                    pairs = [(begin + i, j) for i, j in pairs]
                    # it may have been noticed early, by words in front of the copy: look on from there
                    for start in (pairs[0][0], pairs[len(pairs) // 2][0]):
                        again = align(lower[start : start + reach], template)
                        if len(again) > len(pairs):
                            pairs = [(start + i, j) for i, j in again]
                    yield pairs
                    while last < len(places) and places[last][0] <= pairs[-1][0]:
                        last += 1
                    inside, held, first = Counter(), 0, last
                    while first and places[first - 1][0] > pairs[-1][0]:  # read already, but behind the copy
                        first -= 1
                    last = first
                    continue
                keep_from = max(keep_from, begin + max(1, size // 8))
            while first < last and places[first][0] < keep_from:
                old = places[first][1]
                held -= inside[old] <= count[old]
                inside[old] -= 1
                first += 1

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, start, end, coverage) of every stretch, by start; of overlapping ones the one
        with most matched words stays.  Offsets count code points, the end is exclusive."""
        text = text or ""
        words = [m.span() for m in WORD.finditer(text)]
        lower = [text[a:b].lower() for a, b in words]
        names = {n for w in self.keys.keys() & set(lower) for n in self.keys[w]}
        if not names:
            return []
        found = []
        hits: dict[str, list[tuple[int, str]]] = {n: [] for n in names}
        for i, word in enumerate(lower):
            for name in self.users.get(word, ()):
                if name in names:
                    hits[name].append((i, word))
        for name in names:
            template = self.templates[name]
            for pairs in self.copies(lower, hits[name], name):
                if not self.naming.get(name, set()) <= {j for _, j in pairs}:
                    continue
                found.append((len(pairs), name, pairs[0][0], pairs[-1][0], len(pairs) / len(template)))
        found.sort(key=lambda f: (-f[0], -f[4], f[2], f[1]))
        kept: list[tuple[str, int, int, float]] = []
        taken: list[tuple[int, int]] = []
        for _, name, first, last, share in found:
            if all(last < a or b < first for a, b in taken):
                taken.append((first, last))
                kept.append((name, words[first][0], words[last][1], round(share, 4)))
        return sorted(kept, key=lambda k: (k[1], k[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, licenses, starts, ends, coverages) for every row: parallel lists by start,
    empty where nothing is found or the text is NULL.  One pass, nothing is shuffled.
    ``templates`` travel with the tasks, so they are meant to be some hundreds of texts."""
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for batch in batches:
            found = [scanner.scan(text) for text in batch.column(1).to_pylist()]
            lists = [pa.array([[s[i] for s in spans] for spans in found], pa.list_(kind)) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "licenses", "starts", "ends", "coverages"])

    schema = "doc_id long, licenses array<string>, starts array<long>, ends array<long>, coverages array<double>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, license, coverage, n_found, spans): the best covered license (the first of equals), all spans as text."""
    best = F.array_position("coverages", F.array_max("coverages")).cast("int")
    spans = F.transform(
        F.arrays_zip("licenses", "starts", "ends"),
        lambda s: F.concat_ws(":", s["licenses"], s["starts"].cast("string"), s["ends"].cast("string")),
    )
    return found.select(
        "doc_id",
        F.when(F.size("licenses") > 0, F.element_at("licenses", best)).alias("license"),
        F.coalesce(F.array_max("coverages"), F.lit(0.0)).alias("coverage"),
        F.size("licenses").cast("long").alias("n_found"),
        F.array_join(spans, ",").alias("spans"),
    )
