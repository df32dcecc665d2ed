"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Texts and templates are sequences of words (letters, digits and bytes beyond ASCII; case
folded).  Of every ``WINDOW`` consecutive ``GRAM``-word hashes the smallest is a fingerprint,
so any ``WINDOW + GRAM - 1`` words in common share one.  The templates' fingerprints form an
inverted index.  A text's fingerprints that it holds are grouped by template and diagonal,
and each group is aligned in a band that allows for ``1 - MIN_COVERAGE`` of the template.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm import textual as T
from citegraph.llm.alignment import banded_alignment

GRAM = 2
WINDOW = 2
MIN_COVERAGE = 0.8
#: Characters of all templates together; they go to every task.
MAX_TEMPLATE_CHARS = 8 << 20

# Public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose "
     "with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies"),
    ("MIT", "Released under the MIT License"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
     "this software and associated documentation files, to deal in the Software without "
     "restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0"),
)


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, places)`` of the winnowed grams, the rightmost of equal minima."""
    grams = len(words) - GRAM + 1
    if grams < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = words[:grams] * T.ROLES[0]
    for j in range(1, GRAM):
        hashes = hashes + words[j:j + grams] * T.ROLES[j]
    hashes = T.mix(hashes)
    if grams <= WINDOW:
        at = np.array([grams - 1 - int(np.argmin(hashes[::-1]))])
        return hashes[at], at
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    at = np.arange(len(windows)) + WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1)
    at = np.unique(at)
    return hashes[at], at


class TemplateIndex:
    """Fingerprints of all templates, sorted by hash."""

    def __init__(self, templates):
        self.names = [name for name, _ in templates]
        column = pa.array([text for _, text in templates], pa.string())
        self.words = [h for _, h, _, _ in T.row_word_spans(column, inside=T.ALPHANUMERIC)]
        found = [fingerprints(w) for w in self.words]
        hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.template = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])[order]
        self.place = (np.concatenate([p for _, p in found]) if found
                      else np.zeros(0, np.int64))[order]

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """``(template, first word, end word, coverage)``; of overlapping finds the best stays."""
        hashes, places = fingerprints(words)
        low = np.searchsorted(self.hashes, hashes, side="left")
        counts = np.searchsorted(self.hashes, hashes, side="right") - low
        if not counts.any():
            return []
        at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        template, diagonal = self.template[at], np.repeat(places, counts) - self.place[at]
        found = []
        for which in np.unique(template).tolist():
            own = self.words[which]
            budget = int((1 - MIN_COVERAGE) * len(own) + 1e-9)
            spots = np.unique(diagonal[template == which])
            groups = np.split(spots, np.flatnonzero(np.diff(spots) > 2 * budget + 1) + 1)
            for group in groups:
                # A long chain of near diagonals is aligned one diagonal at a time.
                chain = group[-1] - group[0] <= 4 * (budget + 1)
                for low_d, high_d in ([(group[0], group[-1])] if chain else [(d, d) for d in group]):
                    hit = banded_alignment(own, words, int(low_d) - budget, int(high_d) + budget,
                                           budget)
                    if hit:
                        found.append((which, hit[1], hit[2], 1 - hit[0] / len(own)))
        return self._best(found)

    def _best(self, found):
        kept = []
        for hit in sorted(set(found), key=lambda f: (-f[3], -len(self.words[f[0]]), f[1], f[0])):
            if all(hit[2] <= k[1] or hit[1] >= k[2] for k in kept):
                kept.append(hit)
        return sorted(kept, key=lambda f: (f[1], f[0]))


_FOUND = ("doc_id long, license string, word_start long, word_end long, byte_start long, "
          "byte_end long, coverage double")


def license_spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``(doc_id, license, word_start, word_end, byte_start, byte_end, coverage)`` of every find.

    One row per find in the whole text; texts without any, null and empty ones give none.
    Overlapping finds count for the template that is covered best (then the longer, then the
    first).  Rows that repeat a ``doc_id`` are scanned each; other columns are ignored.
    """
    if sum(len(text) for _, text in templates) > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates exceed {MAX_TEMPLATE_CHARS} characters; scan them in parts")
    index = TemplateIndex(templates)

    def scan(batches):
        for batch in batches:
            rows = []
            spans = T.row_word_spans(batch.column(1), inside=T.ALPHANUMERIC)
            for doc_id, (_, words, starts, ends) in zip(batch.column(0).to_pylist(), spans,
                                                        strict=True):
                rows += [(doc_id, index.names[which], lo, hi, int(starts[lo]), int(ends[hi - 1]),
                          cover) for which, lo, hi, cover in index.matches(words) if hi > lo]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = (pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                  names=[f.split()[0] for f in _FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        scan, _FOUND)
