"""License scans: patience alignment of texts with license notices."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text
from .spots import ANCHORS

# Public notices by name. A parameter of all functions.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "CC BY-NC 4.0": "Licensed under CC BY-NC 4.0.",
    "CC BY-SA 4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."),
    "MIT": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
}
COVERAGE = 0.8

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    """Lower-case words; version numbers and hyphenated words are one."""
    return _WORD.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of equal words a[i] == b[j], ascending in both: a patience alignment.

    Equal words at both ends of a stretch pair up. Words that occur once in the stretch of either text are anchors;
    the longest ascending run of them is kept, and the gaps between them are aligned in the same way.
    """
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
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at]
        last = (a0, b0)
        for i, j in [*_ascending(anchors), (a1, b1)]:
            # the anchor itself is the first word of the gap after it
            if (i, j) != (a1, b1) or last != (a0, b0):
                todo.append((last[0], i, last[1], j))
            last = (i, j)
    return sorted(out)


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second numbers ascend, by piles."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(ends[pile - 1] if pile else -1)
        tops[pile:pile + 1] = [j]
        ends[pile:pile + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _apart(matches: set[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of overlapping matches (coverage, first and last word) the best."""
    kept: list[tuple[float, int, int]] = []
    for m in sorted(matches, key=lambda m: (-m[0], m[2] - m[1], m[1])):
        if all(m[2] < k[1] or m[1] > k[2] for k in kept):
            kept.append(m)
    return kept


class Scanner:
    """Templates made ready for scanning many texts."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: words_of(text) for name, text in sorted(templates.items())}
        common = set(ANCHORS)
        self.telling = {name: set(words) - common or set(words) for name, words in self.templates.items()}
        self.any = set().union(*self.telling.values()) if self.telling else set()

    def scan(self, text: str) -> list[dict]:
        """Where each template stands: name, coverage (share of its words), start and end character. Best ones first."""
        words = words_of(text)
        hits = [i for i, w in enumerate(words) if w in self.any]
        found = []
        for name, template in self.templates.items():
            mine = [i for i in hits if words[i] in self.telling[name]]
            found += [(name, *x) for x in self._matches(words, mine, template, self.telling[name])]
        if not found:
            return []
        spots = [m.span() for m in _WORD.finditer(text.lower())]
        # lower() can lengthen a text; offsets are those of the lower-cased one
        return sorted(({"license": n, "coverage": c, "start": spots[a][0], "end": spots[b][1]} for n, c, a, b in found), key=lambda x: (-x["coverage"], x["license"], x["start"]))

    def _matches(self, words: list[str], hits: list[int], template: list[str], telling: set[str]) -> list[tuple[float, int, int]]:
        size = len(template)
        # a match has so many words of the template that are no common words
        least = max(1, int(self.coverage * size) - sum(w not in telling for w in template))
        out = []
        for window in self._windows(hits, size):
            if len(window) < least:
                continue
            low, high = max(0, window[0] - size), min(len(words), window[-1] + size + 1)
            # no alignment has more words than both hold
            if (Counter(words[low:high]) & Counter(template)).total() < self.coverage * size:
                continue
            wide = []
            pairs = align(words[low:high], template)
            if pairs and len(pairs) >= self.coverage * size:
                wide.append((len(pairs) / size, low + pairs[0][0], low + pairs[-1][0]))
            close = set()
            for begin, end in self._stretches(words, low, high, template):
                pairs = align(words[begin:end], template)
                if pairs and len(pairs) >= self.coverage * size:
                    close.add((len(pairs) / size, begin + pairs[0][0], begin + pairs[-1][0]))
            # an alignment across several copies gives way to them
            apart = _apart(close)
            out += [m for m in wide if sum(m[1] <= k[1] and k[2] <= m[2] for k in apart) < 2] + list(close)
        return _apart(set(out))

    @staticmethod
    def _stretches(words: list[str], low: int, high: int, template: list[str]) -> list[tuple[int, int]]:
        """Stretches of about one template's length where runs of two or more of its words say that a copy begins and ends."""
        size = len(template)
        places: dict[str, list[int]] = {}
        for t, w in enumerate(template):
            places.setdefault(w, []).append(t)
        starts = set()
        for i in range(low, high):
            for t in places.get(words[i], ()):
                if t and i > low and words[i - 1] == template[t - 1]:
                    continue
                if size < 3 or (t + 1 < size and i + 1 < high and words[i + 1] == template[t + 1]):
                    starts.add(i - t)
        return sorted({(max(low, a), min(high, b + size)) for a in starts for b in starts if abs(a - b) <= size // 4})

    @staticmethod
    def _windows(hits: list[int], size: int) -> Iterator[list[int]]:
        """Stretches of hits no longer than two templates; a longer run gives overlapping ones, so that a match lies in one."""
        begin = 0
        for n in range(1, len(hits) + 1):
            if n < len(hits) and hits[n] - hits[n - 1] <= size:
                continue
            run, begin = hits[begin:n], n
            if run[-1] - run[0] <= 2 * size:
                yield run
                continue
            for start in range(run[0], run[-1] + 1, size):
                part = run[bisect_left(run, start):bisect_left(run, start + 2 * size)]
                if part:
                    yield part


def scan_licenses(documents: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """License notices in every whole text, one row per row of `documents`: doc_id, matches, license, coverage.

    matches lists every place where at least `coverage` of a template's words align (license, coverage, start, end in
    characters of the lower-cased text); license and coverage are those of the best match, null and 0 without one.
    Stretches around words that tell a template are aligned with it, and also the
    parts of one copy's length in which runs of its words stand, so several notices in a text, or words that
    repeat elsewhere in it, don't hide one another.

    Null or empty text: no match. Null doc_id and repeated rows: kept. Other columns are not looked at. Nothing is
    shuffled; the templates go to the tasks with the code. Empty table: empty result.
    """
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    shape = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            found = [scanner.scan(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, shape)], ["doc_id", "matches"])

    rows = documents.select("doc_id", whole_text().alias("text"))
    rows = rows.mapInArrow(scanned, f"doc_id {kind}, matches array<struct<license:string,coverage:double,start:int,end:int>>")
    best = F.get("matches", F.lit(0))
    return rows.select("doc_id", "matches", best["license"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"))
