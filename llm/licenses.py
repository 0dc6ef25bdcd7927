"""License notices in texts: winnowed fingerprints pick candidates, banded alignment measures them.

Words are runs of letters and digits, whatever their case. The templates'
winnowed three-word fingerprints make an inverted index, whose size the list of
templates bounds. A text's winnowed fingerprints are looked up in it: a shared
run of ``GRAM + WINDOW - 1`` words is sure to meet. Around every cluster of
meetings on near diagonals the template is aligned with the text in a band, and
the share of its words that match, in order, is its coverage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.words import Words, mixed, slices, words

GRAM, WINDOW = 3, 3
BAND = 8          # words by which an alignment may shift
COVERAGE = 0.8

# fixed values: notices that licenses ask for, by SPDX identifier
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def _grams(h: np.ndarray) -> np.ndarray:
    if len(h) < GRAM:
        return np.zeros(0, np.uint64)
    n = len(h) - GRAM + 1
    return mixed(sum(mixed(h[k:k + n], 21 + k) for k in range(GRAM)), 25)


def _winnowed(grams: np.ndarray) -> np.ndarray:
    """Positions of the least hash of every window; all positions of a shorter run."""
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.arange(len(grams))
    least = np.min([grams[k:k + n] for k in range(WINDOW)], axis=0)
    picked = np.zeros(len(grams), bool)
    for k in range(WINDOW):
        picked[k:k + n] |= grams[k:k + n] == least
    return np.flatnonzero(picked)


class Index:
    """Winnowed fingerprints of templates, sorted, with the template and place of each."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        self.words = [words(pa.array([text]), plain=True).hashes for _, text in templates]
        rows = []
        for t, h in enumerate(self.words):
            grams = _grams(h)
            rows += [(int(grams[p]), t, int(p)) for p in _winnowed(grams)]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)

    def meetings(self, found: Words) -> tuple[np.ndarray, ...]:
        """(text, template, word in the text, word in the template) of equal fingerprints."""
        grams = _grams(found.hashes)
        at = _winnowed(grams)
        doc = np.searchsorted(found.bounds, at, side="right") - 1
        whole = at + GRAM <= found.bounds[doc + 1]
        at, doc = at[whole], doc[whole]
        low, high = (np.searchsorted(self.keys, grams[at], side=s) for s in ("left", "right"))
        hit = np.flatnonzero(high > low)
        times = (high - low)[hit]
        row = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(doc[hit], times), self.template[row], np.repeat(at[hit], times), self.place[row]


def aligned(template: np.ndarray, text: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Most matching words in order of a template and a text, each within ``band`` of the diagonal; as pairs of places.

    Of alignments with as many matches the one whose matches lie closest together wins.
    """
    n, m = len(template), len(text)
    best: list[dict[int, tuple[int, int]]] = [{}]  # row by row: column -> (matches, -first column), in the band
    steps: list[dict[int, str]] = [{}]
    for i in range(1, n + 1):
        row, step = {}, {}
        above = best[i - 1]
        for j in range(max(0, i - band), min(m, i + band + max(0, m - n)) + 1):
            options = [(above.get(j, (0, -j)), "up")]
            if j:
                options.append((row.get(j - 1, (0, -j)), "left"))
                if template[i - 1] == text[j - 1]:
                    matches, first = above.get(j - 1, (0, -(j - 1)))
                    options.append(((matches + 1, first if matches else -(j - 1)), "both"))
            row[j], step[j] = max(options, key=lambda o: o[0])
        best.append(row)
        steps.append(step)
    if not best[n]:
        return []
    top = max(v[0] for v in best[n].values())
    j = min((c for c, v in best[n].items() if v[0] == top), key=lambda c: c + best[n][c][1])
    i, pairs = n, []
    while i and j >= 0 and j in steps[i]:
        move = steps[i][j]
        if move == "both":
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif move == "left":
            j -= 1
        else:
            i -= 1
    return pairs[::-1]


def matches(index: Index, found: Words, coverage: float) -> list[list[tuple[str, int, int, float]]]:
    """For every text (license, first word, last word, coverage), overlapping matches reduced to the longest."""
    out: list[list] = [[] for _ in range(len(found.bounds) - 1)]
    doc, template, at, place = index.meetings(found)
    order = np.lexsort((at, template, doc))
    start = 0
    for k in range(1, len(order) + 1):
        a = order[k - 1]
        if k < len(order):
            b = order[k]
            # a place that is not further on in the template begins another occurrence
            if (doc[a] == doc[b] and template[a] == template[b] and place[b] > place[a]
                    and (at[b] - place[b]) - (at[order[start]] - place[order[start]]) <= BAND):
                continue
        group = order[start:k]
        start = k
        t, d = template[a], doc[a]
        n = len(index.words[t])
        low = max(found.bounds[d], (at[group] - place[group]).min() - BAND // 2)
        high = min(found.bounds[d + 1], (at[group] - place[group]).max() + n + BAND // 2)
        pairs = aligned(index.words[t], found.hashes[low:high], BAND)
        if pairs and len(pairs) >= coverage * n:
            out[d].append((len(pairs), index.names[t], int(low + pairs[0][1]), int(low + pairs[-1][1]), len(pairs) / n))
    for d, rows in enumerate(out):
        if rows:
            taken, kept = [], []
            for n, name, a, b, share in sorted(rows, key=lambda r: (-r[0], -r[4], r[2], r[1])):
                if all(b < x or a > y for x, y in taken):
                    taken.append((a, b))
                    kept.append((name, a, b, share))
            out[d] = sorted(kept, key=lambda r: r[1])
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(key, matches) for every row: structs of license, start, end (code points, end exclusive) and coverage.

    Matches are in order of their start; of overlapping ones the one with most
    matching words stays. A null or empty text has none; null and repeated keys
    keep their rows, other columns are left out; whole texts are scanned and no
    row meets another.
    """
    listed = templates or TEMPLATES
    kind = docs.schema[key].dataType.simpleString()
    shape = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(listed)
        for batch in batches:
            for part in slices(batch):
                found = words(part.column("text"), plain=True)
                rows = []
                for d, own in enumerate(matches(index, found, coverage)):
                    raw = found.data[found.text_bounds[d]:found.text_bounds[d + 1]].tobytes() if own else b""
                    spot = lambda byte: len(raw[:byte - found.text_bounds[d]].decode())
                    rows.append([{"license": name, "start": spot(found.starts[a]), "end": spot(found.ends[b] + 1), "coverage": share}
                                 for name, a, b, share in own])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(rows, shape)], [key, "matches"])

    return (docs.select(docs[key].alias("key"), docs[text].alias("text"))
            .mapInArrow(run, f"`{key}` {kind}, matches array<struct<license:string,start:bigint,end:bigint,coverage:double>>"))
