"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them.

A text is its five-word shingles in order. Each template belongs to the widest window class that fits into it; a text is cut
into windows of every class that has templates, a quarter of a window apart, and each window is signed with the minima
of ``BANDS`` hash functions. All windows of the templates, at every place, are in the index, so a whole copy always has a window
with an equal one: all bands agree. A window with Jaccard similarity s to one of a template meets it with probability
``1 - (1 - s) ** BANDS`` (one minimum a band): over 0.996 for s of 0.5, 0.9999 for 0.68. What the bands find is verified: of the
template's shingles, ``CONTAINED`` or more must stand in a stretch of the text that is as long as the template, and so must all its words with
a digit, which tell versions apart. A match ends where that stretch ends, so a notice that follows is another match. Where templates of
different licences overlap, the one with the larger share is reported.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnstrata.llm.common import map_batches, pieces, string_column
from attnstrata.llm.wordhash import PlainWords, bitmap, maybe_in, mix, shingles

SHINGLE, BANDS, CONTAINED = 5, 8, 0.8
#: Window sizes in shingles; a template uses the largest that leaves room for a quarter more.
CLASSES = (1, 4, 16, 64)
BITS = 16

# Usual notices, by licence. Short ones are whole sentences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                   "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass
class Index:
    names: list[str]
    sets: list[np.ndarray]  # distinct shingles, sorted
    lengths: list[int]  # shingles with repeats
    numbers: list[np.ndarray]  # hashes of the words with a digit
    #: By class: for each band, sorted minima, the template of each, and their bitmap.
    bands: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)


def _minima(hashes: np.ndarray, width: int, band: int) -> np.ndarray:
    """The least hash of a band's function in each run of ``width`` shingles."""
    with np.errstate(over="ignore"):
        out = mix(hashes ^ np.uint64(0x9E37 * (band + 1)))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


def window_class(size: int) -> int:
    """The largest class whose windows, a quarter apart, hit a template of ``size`` shingles whole."""
    return max(c for c in CLASSES if c == 1 or c + max(1, c // 4) - 1 <= size)


def build_index(templates=TEMPLATES) -> Index:
    """The index of templates (name, text); a text of under five words can't be found and is an error."""
    index, by_class = Index([], [], [], []), {}
    for name, text in templates:
        words = PlainWords(pa.array([text], pa.string()))
        hashes = shingles(words.hashes, SHINGLE)
        if not len(hashes):
            raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
        by_class.setdefault(window_class(len(hashes)), []).append((len(index.names), hashes))
        index.names.append(name)
        index.sets.append(np.unique(hashes))
        index.lengths.append(len(hashes))
        digits = np.r_[0, np.cumsum(words.digit)]
        index.numbers.append(words.hashes[digits[words.ends] > digits[words.starts]])
    for width, members in by_class.items():
        for band in range(BANDS if width > 1 else 1):
            minima = [_minima(hashes, width, band) for _, hashes in members]
            owners = np.concatenate([np.full(len(m), k) for m, (k, _) in zip(minima, members, strict=True)])
            pairs = sorted(set(zip(np.concatenate(minima).tolist(), owners.tolist(), strict=True)))
            values = np.array([p[0] for p in pairs], dtype=np.uint64)
            index.bands.setdefault(width, []).append((values, np.array([p[1] for p in pairs]), bitmap(values, BITS)))
    return index


def _candidates(index: Index, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
    """(template, place of the window) that some band finds, in the shingles of a batch whose texts begin at the words ``first``.

    Windows are counted from each text's begin and lie in it, so a text gives the same whatever is beside it.
    """
    found: set[tuple[int, int]] = set()
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(hashes)]
    place, left = np.arange(len(hashes)) - first[text], first[text + 1] - np.arange(len(hashes)) - SHINGLE + 1
    for width, bands in index.bands.items():
        windows = np.flatnonzero((place % max(1, width // 4) == 0) & (left >= width))
        for band, (values, owners, flags) in enumerate(bands):
            minima = _minima(hashes, width, band)[windows] if len(windows) else hashes[:0]
            at = np.flatnonzero(maybe_in(flags, BITS, minima))
            low = np.searchsorted(values, minima[at], side="left")
            high = np.searchsorted(values, minima[at], side="right")
            for start, a, b in zip(windows[at[high > low]].tolist(), low[high > low], high[high > low], strict=True):
                found.update((int(owner), start) for owner in owners[a:b])
    return found


def _verified(index: Index, template: int, places: list[int], words: PlainWords, hashes: np.ndarray, first: int, last: int):
    """(share, first shingle, last shingle) of each copy of a template near some places of a text, shingles ``first`` to ``last``."""
    wanted, size, done = index.sets[template], index.lengths[template], first
    for place in sorted(places):
        low, high = max(done, place - size), min(last, place + 2 * size)
        if place < done or high <= low:
            continue
        hits = low + np.flatnonzero(np.isin(hashes[low:high], wanted))
        best = None
        for begin in hits.tolist():
            if best is not None and begin >= best[1] + size:
                break
            inside = hits[(hits >= begin) & (hits < begin + size)]
            share = len(np.unique(hashes[inside])) / len(wanted)
            if share >= CONTAINED and (best is None or share > best[0]):
                numbers = index.numbers[template]
                if np.isin(numbers, words.hashes[begin : int(inside[-1]) + SHINGLE]).all():
                    best = share, begin, int(inside[-1])
        if best is not None:
            yield best
            done = best[2] + 1


def _best_of_places(found: list[tuple], names: list[str]) -> list[tuple]:
    """Matches (template, share, first, last) of a text without those that a better one of another licence overlaps."""
    kept: list[tuple] = []
    for match in sorted(found, key=lambda m: (-m[1], m[2] - m[3], m[0])):
        _, _, a, b = match
        if not any(names[k[0]] != names[match[0]] and a <= k[3] and k[2] <= b and k[1] > match[1] for k in kept):
            kept.append(match)
    return sorted(kept)


def _scan(shared):
    """Rows (doc_id, license, template, containment, start, end), the text's span in code points."""

    def run(batches):
        index = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = PlainWords(string_column(piece, "text"))
                hashes = shingles(words.hashes, SHINGLE)
                ids = piece.column(piece.schema.get_field_index("doc_id")).to_pylist()
                regions: dict[tuple[int, int], list[int]] = {}
                for template, place in _candidates(index, hashes, words.first):
                    doc = int(np.searchsorted(words.first, place, side="right")) - 1
                    regions.setdefault((doc, template), []).append(place)
                matches: dict[int, list[tuple]] = {}
                for (doc, template), places in regions.items():
                    first, last = int(words.first[doc]), int(words.first[doc + 1]) - SHINGLE + 1
                    for share, a, b in _verified(index, template, places, words, hashes, first, last):
                        matches.setdefault(doc, []).append((template, share, a, b))
                rows = []
                for doc, found in matches.items():
                    begin = int(words.offsets[doc])
                    for template, share, a, b in _best_of_places(found, index.names):
                        start = bytes(words.data[begin : words.starts[a]]).decode("utf-8", "ignore")
                        inside = bytes(words.data[words.starts[a] : words.ends[b + SHINGLE - 1]]).decode("utf-8", "ignore")
                        rows.append((ids[doc], index.names[template], template, share, len(start), len(start) + len(inside)))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "license", "template", "containment", "start", "end"],
                )

    return run


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, template, containment, start, end): every place of a template in a text.

    ``template`` is its number in ``templates``. Null or empty texts, and those of under five words, have none. Rows of a null
    or repeated id are scanned like others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(build_index(templates))
    schema = "doc_id long, license string, template int, containment double, start long, end long"
    return map_batches(rows, _scan(shared), schema)


def op2(docs: DataFrame) -> DataFrame:
    """(doc_id, license, containment, places): licences of each document, with the best containment.

    Null, empty and short texts give no rows, nor does an empty table; rows of one id count as one document.
    """
    return scan(docs).groupBy("doc_id", "license").agg(
        F.round(F.max("containment"), 6).alias("containment"), F.count_distinct("start").alias("places")
    )
