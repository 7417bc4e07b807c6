"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

The word sequences of every template are winnowed and kept in an inverted
index; short templates have all their pairs of words there, since an edit
leaves them little else.  All sequences of a text are looked up.  Hits are
taken in the order of the text: each that no match covers yet is aligned word
by word, within a band around its diagonal, if the words around it could
suffice at all.  Every occurrence is reported.  Texts are scanned where they
lie; the index holds the templates alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Notices and texts of well-known licenses.
TEMPLATES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause-third": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "proprietary": "All rights reserved",
}
#: Words of a sequence and of a window of sequences; templates of fewer than SHORT words have all their pairs in the index.
GRAM, WINNOW, SHORT = 3, 2, 16
#: Share of a template's words that must align, and how far the band reaches as a share of its length, 3 at least.
LEAST_COVERAGE, BAND = 0.8, 0.15
_TOKEN = re.compile(r"\w+")
#: Words that a worker remembers; longer ones than 64 characters are hashed each time.
_KNOWN: dict[str, int] = {}


def _hashes(words: list[str]) -> np.ndarray:
    if len(_KNOWN) > 100_000:
        _KNOWN.clear()
    known, out = _KNOWN, []
    for w in words:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            if len(w) <= 64:
                known[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        n = max(len(h) - size + 1, 0)
        acc = np.full(n, np.uint64(size), dtype=np.uint64)
        for j in range(size):
            acc = (acc ^ (acc >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        return acc ^ (acc >> np.uint64(29))


def winnowed(grams: np.ndarray, window: int = WINNOW) -> list[int]:
    """Positions of the smallest hash of each window, the rightmost of equals."""
    picked: set[int] = set()
    for at in range(max(len(grams) - window + 1, min(len(grams), 1))):
        part = grams[at : at + window]
        picked.add(at + len(part) - 1 - int(part[::-1].argmin()))
    return sorted(picked)


def aligned(template: list[int], words: list[int], band: int, shift: int) -> tuple[int, int, int]:
    """Most words of template that match words in order within a band around diagonal shift; first and last matched word.

    words[j] may match template[i] if abs(j - i - shift) <= band.  Of equal
    alignments the shortest span counts.
    """
    none = (0, 0, -1)  # matched, -span, first
    before: dict[int, tuple[int, int, int]] = {}
    best = (0, 0, -1, -1)
    for i, token in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        lo = i + shift - band
        for j in range(max(0, lo), min(len(words), i + shift + band + 1)):
            skip = max(before.get(j, none), now.get(j - 1, none), key=lambda x: (x[0], x[2]))
            if words[j] == token:
                m, _, first = before.get(j - 1, none)
                hit = (m + 1, 0, first if m else j)
                if (hit[0], hit[2]) >= (skip[0], skip[2]):
                    skip = hit
                    if (hit[0], hit[2] - j) > (best[0], best[2] - best[3]):
                        best = (hit[0], 0, hit[2], j)
            now[j] = skip
        before = now
    return best[0], best[2], best[3]


class Index:
    """Inverted index of the winnowed fingerprints of templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [_hashes(_TOKEN.findall(templates[n].lower())) for n in self.names]
        self.lists = [w.tolist() for w in self.words]
        self.counts = [Counter(w) for w in self.lists]
        self.bands = [max(3, int(BAND * len(w))) for w in self.lists]
        posts: dict[int, dict[int, list[tuple[int, int]]]] = {2: defaultdict(list), GRAM: defaultdict(list)}
        for t, words in enumerate(self.words):
            if len(words) < 2:
                raise ValueError(f"template {self.names[t]!r} has fewer than 2 words")
            short = len(words) < SHORT
            grams = _grams(words, 2 if short else GRAM)
            for at in winnowed(grams, 1 if short else WINNOW):
                posts[2 if short else GRAM][int(grams[at])].append((t, at))
        self.posts = {k: dict(x) for k, x in posts.items()}
        self.keys = {k: np.array(sorted(x), dtype=np.uint64) for k, x in posts.items()}

    def _hits(self, words: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template the (place in the text, place in the template) of its fingerprints, in the order of the text."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size, keys in self.keys.items():
            if not len(keys):
                continue
            grams = _grams(words, size)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            for p in np.flatnonzero(keys[at] == grams).tolist():
                for t, q in self.posts[size][int(grams[p])]:
                    out[t].append((p, q))
        return out

    def _match(self, t: int, words: np.ndarray, shift: int, free: int) -> tuple[int, int, int] | None:
        """(matched words, first, last) of template t around a diagonal, from word ``free`` on, if it covers enough."""
        size, band = len(self.lists[t]), self.bands[t]
        if shift >= free and np.array_equal(words[shift : shift + size], self.words[t]):
            return size, shift, shift + size - 1
        lo = max(free, shift - band)
        near = words[lo : max(lo, shift + size + band)].tolist()
        need, mine = LEAST_COVERAGE * size, self.counts[t]
        if sum(min(n, mine[w]) for w, n in Counter(near).items() if w in mine) < need:
            return None
        n, first, last = aligned(self.lists[t], near, band, shift - lo)
        return (n, first + lo, last + lo) if n >= need else None

    def _occurrences(self, t: int, words: np.ndarray, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        free, vain = 0, set()
        for k, (p, q) in enumerate(hits):
            if p < free or p - q in vain:
                continue
            best = self._match(t, words, p - q, free)
            if best is None:
                vain.add(p - q)
                continue
            # Other diagonals through the same words may cover more.
            tried, j = {p - q}, k + 1
            while best[0] < len(self.lists[t]) and j < len(hits) and hits[j][0] <= best[2]:
                shift = hits[j][0] - hits[j][1]
                j += 1
                if shift not in tried:
                    tried.add(shift)
                    other = self._match(t, words, shift, free)
                    if other is not None and (other[0], other[1] - other[2]) > (best[0], best[1] - best[2]):
                        best = other
            yield best
            free, vain = best[2] + 1, set()

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end) of each match; start and end are offsets of characters."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # letters that grow in lower case would move offsets and word boundaries
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = _hashes(_TOKEN.findall(low))
        found = [(t, *m) for t, hits in self._hits(words).items() for m in self._occurrences(t, words, hits)]
        if not found:
            return []
        # Of overlapping matches the one of most words stays, then that of best coverage.
        starts: list[int] = []
        chosen: list[tuple[int, int, int, int]] = []
        for t, n, first, last in sorted(found, key=lambda x: (-x[1], -x[1] / len(self.lists[x[0]]), x[2], x[0])):
            at = bisect_left(starts, first)
            if (at == 0 or chosen[at - 1][3] < first) and (at == len(starts) or starts[at] > last):
                starts.insert(at, first)
                chosen.insert(at, (t, n, first, last))
        spans = [m.span() for m in _TOKEN.finditer(low)]
        return [(self.names[t], n / len(self.lists[t]), n, spans[first][0], spans[last][1]) for t, n, first, last in chosen]


FOUND = "license string, coverage double, matched long, start long, end long"


def _scanner(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for b in batches:
            rows, got = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for m in index.scan(text) or [(None,) * 5]:
                    rows.append(i)
                    got.append(m)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))],
                names=["_id", "license", "coverage", "matched", "start", "end"],
            )

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each match: id, license, coverage, matched, start, end (offsets of characters).

    A row of docs without a match gives one row with nulls; so do texts that are
    null or empty.  Every occurrence is reported, also of one template several
    times in a row.  Of matches that overlap, the one of most words is reported,
    of equal ones that of best coverage, then the first, then that of the
    template first by name.  The time for a long text grows with its length and
    its hits; whole texts are scanned.  A match of which no fingerprint survived
    is not found: short templates need two neighbouring words, others one of the
    winnowed sequences.  Repeated rows are scanned each.  An empty table gives
    an empty result.  Other columns of docs are not looked at; where the id's
    name is that of a result, the result's name gets an underscore.
    """
    kind = dict(docs.dtypes)[id_col]
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(_scanner(templates or TEMPLATES), f"_id {kind}, {FOUND}")
    return out.toDF(id_col, *(c + "_" if c == id_col else c for c in out.columns[1:]))
