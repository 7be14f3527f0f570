"""License scans by patience alignment of templates against texts.

Method. Text and template are sequences of lower-case alphanumeric words. Words unique to both anchor the alignment; the
longest increasing subsequence of anchors is kept, and the gaps between anchors are aligned in the same way,
after matching common heads and tails. Coverage is matched words over words of the template.

A text may hold a template several times, where no word is unique; so the text is first cut into regions:
places of template words that lie within one template's length of each other. Each region is aligned alone, and the best coverage
per document and template is reported with the number of regions that reach the limit.

To be aligned, a document must hold enough of a template's distinct words for the limit to be possible, which is
counted in numpy for whole batches; the test is a bound and loses nothing.

Edge cases: null, blank or other texts without a template give no row; repeated rows give rows each; templates without words are
refused; a region of a very long text is aligned in a window of twice the template's length around each hit, whole text by whole text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K

TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT-line": "Released under the MIT License.",
    "MIT-line-2": "Permission is hereby granted, free of charge, to any person",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(values)
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        back[k] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = v, k
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict = {}
        for k in range(b0, b1):
            once[b[k]] = -1 if b[k] in once else k
        count: dict = {}
        for k in range(a0, a1):
            if once.get(a[k], -1) >= 0:
                count[a[k]] = -1 if a[k] in count else k
        anchors = sorted((k, once[w]) for w, k in count.items() if k >= 0)
        chain = [anchors[k] for k in increasing([y for _, y in anchors])]
        if not chain:
            continue
        x0, y0 = a0, b0
        for x, y in chain:
            out.append((x, y))
            todo.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
        todo.append((x0, a1, y0, b1))
    return sorted(out)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    data, offsets = K.column_bytes(pa.array(texts, pa.large_string()))
    out: list[np.ndarray] = []
    for w in K.words(data, offsets, lower=True, separators=K.NOT_ALNUM):
        f = w.firsts
        out += [w.hash[f[k] : f[k + 1]] for k in range(w.n)]
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], limit: float):
        np.seterr(over="ignore")
        self.names, self.limit = list(templates), limit
        self.words = _hashes(list(templates.values()))
        if any(not len(w) for w in self.words):
            raise ValueError("a template has no words")
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.ids = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.member = np.zeros((len(self.names), len(self.vocabulary)), np.float32)
        for k, ids in enumerate(self.ids):
            self.member[k, ids] = 1
        # A word of the template may lack once for each of the words that the limit allows to miss.
        self.need = np.array([len(set(ids.tolist())) - (len(ids) - int(np.ceil(limit * len(ids)))) for ids in self.ids])

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(document, template, coverage, first word, last word, regions) of each match."""
        for w in K.words(data, offsets, lower=True, separators=K.NOT_ALNUM):
            at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
            hit = np.flatnonzero(self.vocabulary[at] == w.hash)
            held = np.zeros((w.n, len(self.vocabulary)), np.float32)
            held[w.doc[hit], at[hit]] = 1
            possible = held @ self.member.T >= self.need
            firsts = w.firsts
            for doc in np.flatnonzero(possible.any(1)):
                lo, hi = np.searchsorted(hit, firsts[doc : doc + 2])
                place, ids = hit[lo:hi] - firsts[doc], at[hit[lo:hi]]
                for t in np.flatnonzero(possible[doc]):
                    found = self._regions(place, ids, int(t))
                    if found:
                        best = max(found, key=lambda x: (x[0], -x[1]))
                        yield w.lo + int(doc), int(t), best[0], best[1], best[2], len(found)

    def _regions(self, place: np.ndarray, ids: np.ndarray, t: int) -> list[tuple[float, int, int]]:
        mine = self.member[t, ids] > 0
        place, ids, template = place[mine], ids[mine], self.ids[t].tolist()
        size, out = len(template), []
        cuts = np.flatnonzero(np.diff(place) > size) + 1
        for p, x in zip(np.split(place, cuts), np.split(ids, cuts)):
            if len(p) < self.limit * size:
                continue
            lo = 0
            while lo < len(p):  # windows of a long region; each starts after the last match of the one before
                hi = int(np.searchsorted(p, p[lo] + 2 * size, "right"))
                pairs = patience(x[lo:hi].tolist(), template)
                if len(pairs) >= self.limit * size:
                    out.append((len(pairs) / size, int(p[lo + pairs[0][0]]), int(p[lo + pairs[-1][0]])))
                    lo += pairs[-1][0] + 1
                elif hi >= len(p):
                    break
                else:
                    lo = max(lo + 1, int(np.searchsorted(p, p[lo] + size // 2, "right")))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, limit: float = 0.8) -> DataFrame:
    """doc_id, template, coverage, first_word, last_word, regions: each template that a document holds."""
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, limit)
        for batch in batches:
            rows = list(scanner.scan(*K.column_bytes(batch.column(1))))
            doc, t, coverage, first, last, regions = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array([scanner.names[k] for k in t], pa.string()), pa.array(coverage, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(regions, pa.int64())],
                names=["doc_id", "template", "coverage", "first_word", "last_word", "regions"],
            )

    return common.pick(docs, doc_id="long", text="string").filter(F.col("text").isNotNull()).mapInArrow(run, "doc_id long, template string, coverage double, first_word long, last_word long, regions long")
