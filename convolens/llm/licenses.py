"""License texts in documents: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut into shingles of three words; of every three neighbouring shingles the one of smallest
hash is kept, and an inverted index maps it to its places in the templates. Documents are winnowed the
same way, so any five words in a row that a template has share a fingerprint with it. Hits on near
diagonals form a candidate, which a local alignment in a band around them turns into matched words, their
share of the template (coverage) and a span of the document. Of overlapping matches the one with more
matched words stays.

The index holds templates only; it is small and goes to every task. A document is scanned as a whole, on
its own, so nothing shuffles.

Defined cases: null and empty texts and texts without a license give no row; a row that repeats gives its
matches again; several matches of one document are one row each, also of one license. Extra columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from convolens.llm.text import bounded_batches, utf8

SHINGLE = 3
WINDOW = 3
BAND = 8
MIN_COVERAGE = 0.6
WORD = re.compile(rb"[a-z0-9]+")

# Notices and license texts, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Further common families.
FAMILIES = {
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
        "work."),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
}
# Notices that name no license.
NOTICES = {"All-rights-reserved": "All rights reserved."}
# What the query looks for.
EVERY = {**TEMPLATES, **FAMILIES, **NOTICES}


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that are the smallest, the last of equals, of some window."""
    if not len(hashes):
        return np.empty(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment on the diagonals (text minus template position) from low to high.

    Words that agree count 1, others and gaps -1. Returns matched words and the text span [start, end).
    """
    width = high - low + 1
    # Per diagonal of the row before: (score, matched, start).
    before = [(0, 0, -1)] * (width + 2)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        row = [(0, 0, -1)] * (width + 2)
        for d in range(1, width + 1):
            j = i + low + d - 1
            if not 0 <= j < len(text):
                continue
            score, matched, start = before[d]
            if text[j] == word:
                here = (score + 1, matched + 1, start if score else j)
            else:
                here = (score - 1, matched, start)
            # A word of the template left out, or one of the text.
            for score, matched, start in (before[d + 1], row[d - 1]):
                if score - 1 > here[0]:
                    here = (score - 1, matched, start)
            if here[0] > 0:
                row[d] = here
                if here[0] > best[0]:
                    best = (here[0], here[1], here[2], j + 1)
        before = row
    return best[1], best[2], best[3]


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE, band: int = BAND):
        self.min_coverage, self.band = min_coverage, band
        self.names = sorted(templates)
        split = [words_of(templates[n].encode()) for n in self.names]
        self.number = {w: i for i, w in enumerate(sorted({w for words in split for w in words}), 1)}
        self.templates = [np.array([self.number[w] for w in words], np.int64) for words in split]
        if short := [n for n, ids in zip(self.names, self.templates) if len(ids) < SHINGLE]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.index, always = defaultdict(list), set()
        for t, ids in enumerate(self.templates):
            hashes = self.hashes(ids)
            # A template below the winnowing guarantee is looked up at every place.
            short = len(hashes) < WINDOW
            for at in range(len(hashes)) if short else winnow(hashes).tolist():
                self.index[int(hashes[at])].append((t, at))
            always |= set(hashes.tolist()) if short else set()
        self.known, self.always = (np.array(sorted(keys), np.uint64) for keys in (self.index, always))

    @staticmethod
    def hashes(ids: np.ndarray) -> np.ndarray:
        """Hashes of the shingles; one with a word that no template has gets the largest value."""
        if len(ids) < SHINGLE:
            return np.empty(0, np.uint64)
        views = np.lib.stride_tricks.sliding_window_view(ids, SHINGLE)
        mixed = np.zeros(len(views), np.uint64)
        for column in range(SHINGLE):
            mixed = (mixed ^ views[:, column].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.where((views == 0).any(axis=1), np.uint64((1 << 64) - 1), mixed)

    def candidates(self, ids: np.ndarray):
        """(template, lowest and highest diagonal) of hits that lie close together.

        Repeats may chain over the whole document; a long chain is cut, and its parts overlap by a template.
        """
        hashes = self.hashes(ids)
        places = winnow(hashes)
        places = places[np.isin(hashes[places], self.known)]
        if len(self.always):
            places = np.union1d(places, np.flatnonzero(np.isin(hashes, self.always)))
        hits = defaultdict(list)
        for at in places.tolist():
            for t, inside in self.index[int(hashes[at])]:
                hits[t].append(at - inside)
        for t, found in hits.items():
            found, size = np.unique(found), len(self.templates[t])
            for chain in np.split(found, np.flatnonzero(np.diff(found) > self.band) + 1):
                at = 0
                while at < len(chain):
                    to = int(np.searchsorted(chain, chain[at] + 2 * size + self.band, "right"))
                    yield t, max(int(chain[0]), int(chain[at]) - size), min(int(chain[-1]), int(chain[to - 1]) + size)
                    at = to

    def matches(self, ids: np.ndarray, t: int, low: int, high: int):
        """(matched words, start, end) of the matches on the diagonals: the best, then those left and right of it."""
        template = self.templates[t]
        parts = [(max(0, low - self.band), min(len(ids), high + len(template) + self.band))]
        while parts:
            first, last = parts.pop()
            if last - first < self.min_coverage * len(template):
                continue
            matched, start, end = align(template, ids[first:last], low - self.band - first, high + self.band - first)
            if matched and matched >= self.min_coverage * len(template):
                yield matched, first + start, first + end
                parts += [(first, first + start), (first + end, last)]

    def scan(self, text: bytes):
        """(license, coverage, matched words, template words, first and last byte + 1) of each match."""
        ids = np.fromiter(map(lambda w: self.number.get(w, 0), words_of(text)), np.int64)
        matches = {(-matched, -matched / len(self.templates[t]), t, start, end)
                   for t, low, high in self.candidates(ids) for matched, start, end in self.matches(ids, t, low, high)}
        if not matches:
            return
        spans = [m.span() for m in WORD.finditer(text.lower())]
        kept = []
        for matched, coverage, t, start, end in sorted(matches):
            at = bisect(kept, (start, end))
            if (not at or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
                kept.insert(at, (start, end))
                yield self.names[t], -coverage, -matched, len(self.templates[t]), spans[start][0], spans[end - 1][1]


SCHEMA = ("doc_id long, license string, coverage double, matched_words int, template_words int, "
          "start_char long, end_char long")


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, min_coverage: float = MIN_COVERAGE,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per match: doc_id, license, coverage, matched_words, template_words, start_char, end_char.

    Templates are texts by name, or a table whose first two columns are name and text; ``TEMPLATES`` by default.
    """
    if isinstance(templates, DataFrame):
        templates = {row[0]: row[1] for row in templates.collect()}
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(templates, min_coverage)
        types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                at = before = 0
                for name, coverage, matched, words, start, end in sorted(scanner.scan(text), key=lambda m: m[4]):
                    # Byte places become character places.
                    before += len(text[at:start].decode("utf-8", "replace"))
                    at = start
                    out.append((doc, name, coverage, matched, words, before,
                                before + len(text[start:end].decode("utf-8", "replace"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    bounded_batches(docs.sparkSession)
    return docs.selectExpr(f"CAST(`{id_column}` AS long) AS doc_id", f"`{text_column}`").mapInArrow(run, SCHEMA)
