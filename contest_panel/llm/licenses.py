"""Operator 1, licence scan: winnowed template fingerprints, then banded alignment.

Templates are notices and standard texts. Every run of ``RUN`` words of a template is hashed, and of each
``WINDOW`` neighbouring hashes the smallest is kept: an inverted index of fingerprints gives template and place.
All runs of a text are looked up; hits of one template near one diagonal are a candidate, which is aligned with
the template inside a band around the diagonal. Reported are the share of template words matched in order and the
span from the first to the last of them.

The index is as large as the templates, so it travels with the tasks; nothing is shuffled.

Defined results: NULL and empty texts have no matches (and no rows); a text may match several times; where
matches overlap, the one with more matched words stays, then the one whose template is listed first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from contest_panel.llm.common import map_texts
from contest_panel.llm.words import alnum_words, char_places, runs

RUN = 3
WINDOW = 3
BAND = 8
COVERAGE = 0.8

# Notices and standard texts as their owners publish them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Released under the MIT License",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "all-rights-reserved": "All rights reserved",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of every ``window`` neighbours."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, int)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


@dataclass(frozen=True)
class Index:
    """Inverted index of the templates' fingerprints."""

    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray  # sorted distinct fingerprints
    postings: list[list[tuple[int, int]]]  # (template, place) of each

    @classmethod
    def of(cls, templates: dict[str, str], run: int, window: int) -> Index:
        words = [alnum_words(t)[0] for t in templates.values()]
        where: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, own in enumerate(words):
            found = runs(own, run)
            for place in winnow(found, window).tolist():
                where[int(found[place])].append((number, place))
        keys = np.array(sorted(where), np.uint64)
        return cls(list(templates), words, keys, [where[int(k)] for k in keys])


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int] | None:
    """(matched words, first, last) of the best common subsequence inside the band around ``diagonal``.

    ``diagonal``: place in the text of the template's first word. Best: most matches, then the shortest span.
    """
    width = 2 * band + 1
    nothing = (0, 0, 0)  # (matches, -span, first) so that larger is better
    above: list[tuple[int, int, int]] = [nothing] * (width + 1)
    best, best_last = nothing, -1
    for i, word in enumerate(template.tolist()):
        row: list[tuple[int, int, int]] = []
        for b in range(width):
            j = i + diagonal + b - band
            now = above[b + 1] if b + 1 < width else nothing  # the template's word is left out
            if b and row[b - 1] > now:
                now = row[b - 1]  # the text's word is left out
            if 0 <= j < len(text) and text[j] == word:
                n, _, first = above[b]
                first = first if n else j
                hit = (n + 1, first - j, first)
                if hit > now:
                    now = hit
                    if hit[:2] > best[:2]:
                        best, best_last = hit, j
            row.append(now)
        above = [*row, nothing]
    return (best[0], best[2], best_last) if best[0] else None


def matches(text: str, index: Index, run: int, band: int, least: float) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) of a text, in order of start; offsets in code points."""
    words, start, end, raw = alnum_words(text)
    found = runs(words, run)
    if not len(found):
        return []
    at = np.minimum(np.searchsorted(index.keys, found), len(index.keys) - 1)
    hits = np.flatnonzero(index.keys[at] == found)
    if not len(hits):
        return []
    diagonals: dict[int, list[int]] = defaultdict(list)
    for place in hits.tolist():
        for template, own in index.postings[at[place]]:
            diagonals[template].append(place - own)
    candidates = []
    for template, places in diagonals.items():
        own, last = index.words[template], None
        for diagonal in sorted(set(places)):
            if last is not None and diagonal - last <= band:
                continue
            last = diagonal
            got = align(own, words, diagonal, band)
            if got and got[0] >= least * len(own):
                candidates.append((got[0], -template, got[1], got[2]))
    chosen: list[tuple[int, int, int, int]] = []
    for c in sorted(set(candidates), reverse=True):
        if all(c[3] < o[2] or c[2] > o[3] for o in chosen):
            chosen.append(c)
    chosen.sort(key=lambda c: c[2])
    spots = char_places(raw, np.array([[start[a], end[b]] for _, _, a, b in chosen], int).reshape(-1, 2))
    return [
        (index.names[-t], n / len(index.words[-t]), n, int(a), int(b)) for (n, t, _, _), (a, b) in zip(chosen, spots)
    ]


def scan(
    frame: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] | None = None,
    run: int = RUN,
    window: int = WINDOW,
    band: int = BAND,
    least: float = COVERAGE,
) -> DataFrame:
    """One row per match: key, template, coverage, n_matched, start, end (code points, end exclusive)."""
    index = Index.of(templates or TEMPLATES, run, window)

    def work(slices: Iterator) -> Iterator[dict]:
        for batch, texts in slices:
            rows = [(k, *m) for k, t in enumerate(texts) for m in matches(t, index, run, band, least)]
            of, *columns = zip(*rows) if rows else [()] * 6
            names = ("template", "coverage", "n_matched", "start", "end")
            yield {"key": batch.column(0).take(list(of)) if of else batch.column(0).slice(0, 0)} | dict(zip(names, columns))

    kind = frame.schema[key].dataType.simpleString()
    schema = f"key {kind}, template string, coverage double, n_matched int, start long, end long"
    return map_texts(frame, {"key": key}, text, schema, work).withColumnRenamed("key", key)
