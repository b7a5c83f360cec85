"""License scans by MinHash bands over overlapping text windows.

Templates fall in size classes. For templates of at most m words, windows of 2m words begin every m words, so any span of m
words lies whole in one window. A window and a template meet if they agree in one of at least `BANDS` bands of one MinHash value. A class has
as many bands as its shortest template needs, at the least Jaccard similarity J that a window containing it to 0.8 can have
(`needed`), to be missed with a probability of at most `MISS`: (1 - J) ** bands <= 5e-10. Templates of one shingle are looked
up exactly and never missed. Exact shingle containment decides.

A window that shares no shingle with any template can't contain one; only windows that do are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

BANDS = 48
CONTAINMENT = 0.8
MISS = 5e-10

# Wordings of public license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-work": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def needed(size: int, window: int, containment: float = CONTAINMENT) -> int:
    """Bands by which a template of `size` shingles, contained in a window of at most `window`, is missed with `MISS` at most."""
    shared = max(1, ceil(containment * size - 1e-9))
    least = shared / (window + size - shared)
    return 1 if least >= 1 else ceil(log(MISS) / log(1 - least))


class Scanner:
    """Templates by size class, shingle length and MinHash value."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS, containment: float = CONTAINMENT, seed: int = 3):
        vocabulary, rng = W.Vocabulary(), np.random.default_rng(seed)
        self.containment = containment
        self.classes: dict[tuple[int, int], dict] = {}
        for name, text in sorted(templates.items()):
            w = np.array(vocabulary.hashes(text.encode()), np.uint64)
            if not len(w):
                continue
            k = min(W.SHINGLE, len(w))
            m = 1 << max(2, int(len(w) - 1).bit_length())
            own = self.classes.setdefault((k, m), {"names": [], "sets": [], "single": {}})
            s = np.unique(W.shingles(w, k))
            if len(s) == 1:
                own["single"].setdefault(int(s[0]), []).append(len(own["names"]))
            own["names"].append(name)
            own["sets"].append(s)
        most = {c: max([bands, *(needed(len(s), 2 * c[1] - c[0] + 1, containment) for s in own["sets"] if len(s) > 1)]) for c, own in self.classes.items()}
        self.factor = rng.integers(1, 1 << 63, max(most.values(), default=0), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, len(self.factor), dtype=np.uint64)
        for c, own in self.classes.items():
            own["bands"] = [{} for _ in range(most[c] if any(len(s) > 1 for s in own["sets"]) else 0)]
            for j, s in enumerate(own["sets"]):
                if len(s) > 1:
                    for band, v in zip(own["bands"], self.minima(s, most[c]).tolist()):
                        band.setdefault(v, []).append(j)
            own["lookup"] = W.Lookup(np.concatenate(own["sets"]))

    def minima(self, s: np.ndarray, bands: int) -> np.ndarray:
        """One MinHash value a band."""
        x = s[None, :] * self.factor[:bands, None] + self.shift[:bands, None]
        x ^= x >> np.uint64(31)
        return (x * np.uint64(0x94D049BB133111EB)).min(axis=1)

    def scan(self, texts: list[bytes | None], vocabulary: W.Vocabulary) -> list[tuple[int, str, float, int]]:
        """(number of the text, template, best containment, first word of the first best window)."""
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for first, w, starts in W.blocks(texts, vocabulary):
            hashed: dict[int, np.ndarray] = {}
            for (k, m), own in self.classes.items():
                h = hashed[k] if k in hashed else hashed.setdefault(k, W.shingles(w, k))
                at, _ = own["lookup"].find(h)
                text = np.searchsorted(starts, at, side="right") - 1
                whole = at + k <= starts[text + 1]
                at, text = at[whole], text[whole]
                if not len(at):
                    continue
                cell = (at - starts[text]) // m
                both = np.concatenate([np.stack([text, cell], axis=1), np.stack([text, np.maximum(cell - 1, 0)], axis=1)])
                for t, c in np.unique(both, axis=0).tolist():
                    s = int(starts[t]) + c * m
                    window = np.unique(h[s : min(s + 2 * m, int(starts[t + 1])) - k + 1])
                    if not len(window):
                        continue
                    met = {j for v in own["single"].keys() & window.tolist() for j in own["single"][v]}
                    if own["bands"]:
                        met |= {j for band, v in zip(own["bands"], self.minima(window, len(own["bands"])).tolist()) for j in band.get(v, ())}
                    for j in sorted(met):
                        share = len(np.intersect1d(window, own["sets"][j], assume_unique=True)) / len(own["sets"][j])
                        key = first + t, own["names"][j]
                        if share >= self.containment and share > best.get(key, (0.0, 0))[0]:
                            best[key] = (share, c * m)
        return [(t, name, *v) for (t, name), v in sorted(best.items())]


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word): each template that a text contains, at its first best window.

    Null, empty and blank texts match nothing. Templates of fewer than five words are one shingle, whole. Rows that repeat
    a doc_id are scanned each; a null doc_id is returned as such. Other columns are ignored; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    notices = TEMPLATES if templates is None else templates  # a list that callers give; it doesn't grow with the data
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, vocabulary = Scanner(notices, bands, containment), W.Vocabulary()
        for b in batches:
            ids = b.column(0).to_pylist()
            found = [(ids[t], *rest) for t, *rest in scanner.scan([x.as_py() for x in b.column(1)], vocabulary)]
            if found:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*found), kinds)], names=["doc_id", "license", "containment", "first_word"])

    return rows.mapInArrow(run, "doc_id bigint, license string, containment double, first_word bigint")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    return scanned(read_table(spark, sf_dir, "documents"))
