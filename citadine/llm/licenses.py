"""Operator 4: license scans by winnowed fingerprints and banded alignment.

Templates become runs of words (letters and digits, lower-cased); of the hashes of their k-word runs, winnowing keeps the smallest of every w in a
row, in an inverted index from hash to template and place. Any stretch of a template of k + w - 1 words that a text repeats hits the index. Hits of one template on
nearby diagonals are one candidate; a banded alignment of the template with the words around it tells how many of its words are
matched in order, and where. Candidates whose coverage reaches the threshold are reported; of overlapping ones the one with most matched words.

Templates are short notices, openings and headers, and whole license texts (``license_texts``), each both as a whole and by its passages. A whole license
is one row with the coverage and span of the license; where less than the threshold of it is there, its passages are found by themselves, so
neither needs the opening. Of long templates only places are aligned whose words, in any order, could reach the threshold, which loses none.

The templates are a parameter of bounded size and travel with the task; documents are read once and not shuffled.

Null and empty texts have no hits. Rows with null or repeated doc_id are read each by itself. Extra columns are ignored. Empty tables give empty
results. Texts of any length are scanned whole. Ties between templates go to the one whose name comes first.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citadine.llm import words

#: Short public notices, and the openings and headers of public licenses.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0 notice": "Released into the public domain under CC0 1.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0 whole header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL whole header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL whole header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>.",
    "all rights reserved": "Copyright. All rights reserved. No part of this publication may be reproduced",
}
#: Licenses whose whole texts are in the folder license_texts.
WHOLE = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
PASSAGE = 12  # words of a passage, at least
BREAK = re.compile(r"\n\s*\n|\n(?=\s*(?:[0-9]+\.|\(?[a-z]\))\s)")
LONG = 40  # words of a template that is aligned by arrays
K, W = 3, 2
GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(97, 123), *range(0x80, 0x100)]] = False
SCHEMA = "doc_id long, template string, n_matched long, coverage double, start long, end long"


def passages(text: str, least: int = PASSAGE) -> list[str]:
    """Paragraphs and items of lists; those with fewer words, such as headings, are joined with what follows, the last with what is before."""
    out, held = [], ""
    for part in BREAK.split(text):
        held += "\n\n" + part
        if len(held.split()) >= least:
            out.append(held)
            held = ""
    return [*out[:-1], out[-1] + held] if out else [held]


def registered() -> dict[str, str]:
    """All templates: the fixed ones, and each license text whole and, if it has several, by passages."""
    out = dict(TEMPLATES)
    for name in WHOLE:
        text = (resources.files("citadine.llm") / "license_texts" / f"{name}.txt").read_text()
        out[f"{name} text"] = text
        parts = passages(text)
        if len(parts) > 1:
            out |= {f"{name} text, part {k:03d}": x for k, x in enumerate(parts, 1)}
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = words.text_bytes(texts)
    starts, ends, firsts = words.word_spans(words.LOWER[raw], offsets, GAPS)
    return words.span_hashes(words.LOWER[raw], starts, ends), starts, ends, firsts, offsets


def winnowed(hashes: np.ndarray, k: int = K, w: int = W) -> np.ndarray:
    """Places of the kept k-word runs: the last smallest of every w in a row."""
    runs = words.grams(hashes, k)
    if len(runs) <= w:
        return np.array([np.argmin(runs)]) if len(runs) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(runs, w)[:, ::-1]
    return np.unique(np.arange(len(windows)) + w - 1 - windows.argmin(1))


def aligned(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Words of the template matched in order within ``band`` of the diagonal text place = template place + shift, with as few steps
    aside as that allows; and the first and last text place matched."""
    worst = (-1, 0, 0, 0)
    row: dict[int, tuple[int, int, int, int]] = {}  # by text places used: matched, -steps aside, first, last
    for j in range(max(0, shift - band), min(len(text), shift + band) + 1):
        row[j] = (0, 0, -1, -1)
    for i, word in enumerate(template):
        new: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + 1 + shift - band), min(len(text), i + 1 + shift + band) + 1):
            best = worst
            if j in row:
                m, s, a, b = row[j]
                best = max(best, (m, s - 1, a, b))
            if j - 1 in new:
                m, s, a, b = new[j - 1]
                best = max(best, (m, s - 1, a, b))
            if j - 1 in row:
                m, s, a, b = row[j - 1]
                best = max(best, (m + 1, s, a if a >= 0 else j - 1, j - 1) if text[j - 1] == word else (m, s - 1, a, b))
            if best[0] >= 0:
                new[j] = best
        row = new
    matched, _, first, last = max(row.values(), default=worst)
    return matched, first, last


#: Fields of a state of aligned_long, in one integer that orders as (matched, -steps aside, first, last).
LAST, FIRST, STEP, MATCH = 1, 1 << 15, 1 << 30, 1 << 46
NEVER = -(1 << 62)


def aligned_long(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """The same as aligned, a row at a time; the template and twice the band together have fewer than 2^15 words."""
    size, width, low = len(template), 2 * band + 1, shift - band
    place = low + np.arange(size + width)
    inside = (place >= 0) & (place < len(text))
    valid = (place >= 0) & (place <= len(text))
    word = np.zeros(len(place), np.uint64)
    word[inside] = text[place[inside]]
    aside = np.arange(width) * STEP
    row = np.where(valid[:width], np.int64(STEP << 15), NEVER)
    mark = np.arange(1, len(place) + 1)
    above = np.full(width, NEVER)
    for i in range(size):
        above[:-1] = row[1:]
        here = mark[i : i + width]
        hit = (row & ~(FIRST - 1)) + MATCH + here
        hit += np.where(row & (STEP - FIRST), 0, here * FIRST)
        best = np.where(inside[i : i + width] & (word[i : i + width] == template[i]), hit, row - STEP)
        best = np.maximum(best, above - STEP)
        best = np.maximum.accumulate(best + aside) - aside
        row = np.where(valid[i + 1 : i + 1 + width], best, NEVER)
    top = int(row.max(initial=NEVER))
    if top < 0:
        return -1, 0, 0
    place_of = lambda x: x - 1 + low if x else -1
    return top // MATCH, place_of(top // FIRST % FIRST), place_of(top % FIRST)


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        hashes, _, _, firsts, _ = tokens(pa.array([templates[n] for n in self.names]))
        self.words = [hashes[i:j] for i, j in zip(firsts, firsts[1:])]
        self.bags = [np.unique(x, return_counts=True) for x in self.words]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, own in enumerate(self.words):
            runs = words.grams(own, K)
            for at in winnowed(own).tolist():
                self.places[int(runs[at])].append((t, at))
        self.keys = np.array(sorted(self.places), np.uint64)

    def hits(self, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Places of all texts' k-word runs that are in the index."""
        runs = words.grams(hashes, K)
        if not len(runs) or not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, runs), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[at] == runs)
        doc = np.searchsorted(firsts, found, side="right")
        return found[found + K <= firsts[doc]]

    def most(self, t: int, text: np.ndarray) -> int:
        """An upper bound of the words of the template that the text matches: those that both have, in any order."""
        own, counts = self.bags[t]
        at = np.minimum(np.searchsorted(own, text), len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == text], minlength=len(own)), counts).sum())

    def found(self, text: np.ndarray, hits: list[tuple[int, int]], coverage: float) -> list[tuple[int, int, int, int]]:
        """template, words matched, first and last word of each report; ``hits`` are places and hashes."""
        diagonals = defaultdict(set)
        for at, key in hits:
            for t, place in self.places[key]:
                diagonals[t].add(at - place)
        out = []
        for t, shifts in diagonals.items():
            size = len(self.words[t])
            band, last = max(2, size // 5), None
            for shift in sorted(shifts):
                if last is not None and shift - last <= band:
                    continue
                last = shift
                if size >= LONG:
                    near = text[max(0, shift - 2 * band) : max(0, size + shift + 2 * band)]
                    if len(near) < coverage * size or self.most(t, near) < coverage * size:
                        continue
                    long = size + 4 * band < (1 << 15) - 2
                    matched, first, end = (aligned_long if long else aligned)(self.words[t], text, shift, 2 * band)
                else:
                    matched, first, end = aligned(self.words[t].tolist(), text.tolist() if len(text) < 4 * size else _Slice(text), shift, 2 * band)
                if matched >= coverage * size:
                    out.append((t, matched, first, end))
        best: list[tuple[int, int, int, int]] = []  # in order of their places, and none overlaps another
        for x in sorted(out, key=lambda x: (-x[1], x[3] - x[2], x[0], x[2])):
            at = bisect_right(best, x[2], key=lambda y: y[2])
            if (at == 0 or best[at - 1][3] < x[2]) and (at == len(best) or x[3] < best[at][2]):
                best.insert(at, x)
        return best


class _Slice:
    """Words of a long text as Python integers, one by one."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def __len__(self) -> int:
        return len(self.hashes)

    def __getitem__(self, at: int) -> int:
        return int(self.hashes[at])


def _scan(index: Index, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words.pieces(batches):
            hashes, starts, ends, firsts, offsets = tokens(piece.column("text"))
            hits = index.hits(hashes, firsts)
            runs = words.grams(hashes, K)
            rows = []
            cuts = np.searchsorted(hits, firsts)
            for d in np.flatnonzero(np.diff(cuts)).tolist():
                first = int(firsts[d])
                own = hits[cuts[d] : cuts[d + 1]]
                text = piece.column("text")[d].as_py().encode()
                point = lambda at: len(text[: at - offsets[d]].decode())  # noqa: B023, E731
                for t, matched, a, b in index.found(hashes[first : firsts[d + 1]], [(int(h) - first, int(runs[h])) for h in own], coverage):
                    rows.append((d, index.names[t], matched, matched / len(index.words[t]), point(starts[first + a]), point(ends[first + b])))
            if rows:
                d, *columns = zip(*rows)
                kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(d)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """One row per license found in a text: doc_id, template, n_matched words, coverage of the template, start and end in code points."""
    return docs.select("doc_id", "text").mapInArrow(_scan(Index(templates or registered()), coverage), SCHEMA)


def op4(docs: DataFrame) -> DataFrame:
    return scan(docs)
