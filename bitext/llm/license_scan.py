"""License scans (operator 2).

Templates and texts are read as words (case and ASCII punctuation aside).
Hashes of SHINGLE-word runs of each template are winnowed (the smallest of
every WINDOW neighbouring hashes), which gives an inverted index from
fingerprint to (template, place).  Every run of a whole text is looked up;
hits on nearby diagonals of one template form a candidate, and a banded
alignment of the template with that part of the text (longest common
subsequence of words within BAND, or a quarter of the template, of the
diagonal) tells which template words
are there and where.  A template match of WINDOW + SHINGLE - 1 words or more
always has a fingerprint.

Candidates of one template whose text parts overlap are one occurrence; the
best alignment is reported.  Templates are a fixed, bounded catalogue and a
parameter.

Cases: null and empty texts report nothing; repeated rows report each; a
template shorter than SHINGLE words is refused; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .registry import query, table

SHINGLE, WINDOW, BAND = 3, 2, 12
MIN_COVERAGE = 0.6

#: Wording of public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software"),
    "reserved": "All rights reserved.",
}

FOUND = ("doc_id long, template string, coverage double, n_matched long, start_byte long, end_byte long, "
         "spans array<struct<start: long, end: long>>")


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the smallest hash (the last on ties) of each window."""
    if len(hashes) <= window:
        return [len(hashes) - 1 - int(np.argmin(hashes[::-1]))] if len(hashes) else []
    chosen = set()
    for s in range(len(hashes) - window + 1):
        chosen.add(s + window - 1 - int(np.argmin(hashes[s: s + window][::-1])))
    return sorted(chosen)


def build_index(templates: dict[str, str], shingle: int = SHINGLE, window: int = WINDOW):
    """(names, word hashes of each, sorted fingerprints, their (template, place))."""
    names = sorted(templates)
    words = tk.plain_words([templates[n] for n in names])
    posts = []
    for t, w in enumerate(words):
        if len(w) < shingle:
            raise ValueError(f"template {names[t]} has fewer than {shingle} words")
        grams = tk.windows(w, shingle)
        posts += [(int(grams[p]), t, p) for p in winnow(grams, window)]
    posts.sort()
    return (names, words, np.array([p[0] for p in posts], np.uint64), np.array([p[1:] for p in posts], np.int64).reshape(-1, 2))


def align(template: list, text: list, diagonal: int, band: int = BAND) -> list[tuple[int, int]]:
    """Matched (template place, text place) pairs of a longest common
    subsequence within ``band`` of text place = template place + diagonal."""
    n, width = len(template), 2 * band + 1
    best = np.zeros((n + 1, width + 1), np.int32)  # best[i, j]: template[i:], text from i + diagonal - band + j
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(width - 1, -1, -1):
            at = i + diagonal - band + j
            take = below[j] + 1 if 0 <= at < len(text) and text[at] == template[i] else -1
            skip_template = below[j - 1] if j else 0
            row[j] = max(take, skip_template, row[j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < width:
        at = i + diagonal - band + j
        if 0 <= at < len(text) and text[at] == template[i] and best[i, j] == best[i + 1, j] + 1:
            pairs.append((i, at))
            i += 1
        elif best[i, j] == best[i, j + 1]:
            j += 1
        else:
            i += 1
            j -= 1
    return pairs


def _occurrences(words: np.ndarray, index, band: int, least: float):
    """(template, matched pairs) of each occurrence in one text."""
    names, templates, prints, posts = index
    grams = tk.windows(words, SHINGLE)
    left, right = np.searchsorted(prints, grams, "left"), np.searchsorted(prints, grams, "right")
    hits: dict[int, list[tuple[int, int]]] = {}
    for p in np.flatnonzero(right > left):
        for t, place in posts[left[p]: right[p]]:
            hits.setdefault(int(t), []).append((int(p) - int(place), int(p)))
    for t, found in hits.items():
        want, kept, tried = templates[t].tolist(), [], []
        n = len(want)
        around = max(1, min(band, n // 4))  # short templates may follow each other closely
        for diagonal, _ in sorted(found, key=lambda h: h[1]):
            if tried and abs(diagonal - tried[-1]) <= around // 2:
                continue  # the band around the last diagonal covers it
            tried.append(diagonal)
            lo = max(0, diagonal - around)
            part = words[lo: max(lo, diagonal + n + around)].tolist()
            pairs = [(i, j + lo) for i, j in align(want, part, diagonal - lo, around)]
            if len(pairs) >= least * n:
                kept.append(pairs)
        kept.sort(key=lambda p: (-len(p), p[-1][1] - p[0][1], p[0][1]))
        used: list[tuple[int, int]] = []
        for pairs in kept:
            a, b = pairs[0][1], pairs[-1][1]
            if all(b < x or a > y for x, y in used):
                used.append((a, b))
                yield t, pairs


def _scan(index, band: int, least: float):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        names, templates = index[:2]
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            data, off = tk.plain_utf8(batch.column(1))
            for lo, hi in tk.slices(off):
                part, o = data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
                starts, ends, at = tk.pieces(part, o, tk.SPACE)
                h = tk.piece_hashes(part, starts, ends)
                for i in range(hi - lo):
                    s, e, base = starts[at[i]: at[i + 1]], ends[at[i]: at[i + 1]], int(o[i])
                    for t, pairs in _occurrences(h[at[i]: at[i + 1]], index, band, least):
                        places = [j for _, j in pairs]
                        runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
                        spans = [{"start": int(s[r[0]]) - base, "end": int(e[r[-1]]) - base} for r in runs]
                        out.append((ids[lo + i], names[t], len(pairs) / len(templates[t]), len(pairs),
                                    spans[0]["start"], spans[-1]["end"], spans))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), spans_type]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["doc_id", "template", "coverage", "n_matched", "start_byte", "end_byte", "spans"])
    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, band: int = BAND,
                  min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per occurrence of a template: doc_id, template, coverage (share
    of its words), n_matched, start_byte and end_byte in the lower-cased UTF-8
    text, spans (runs of matched words)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(build_index(templates), band, min_coverage), FOUND)


@query("op2_license_scan")
def op2(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
