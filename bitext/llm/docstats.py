"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from . import textkit as tk

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b",;:'\"()-")] = True

#: Counts per text.  Words are ``[^\x20\x09-\x0D]+``; lines are \n-split and
#: hold a word; repeated words lie in a 3-word window found twice or more.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
          "n_upper", "n_digits", "n_stops", "n_punct", "n_long_words")


def _distinct(hashes: np.ndarray) -> int:
    return len(np.unique(hashes))


def _repeated(words: np.ndarray) -> int:
    grams = tk.windows(words, 3)
    if not len(grams):
        return 0
    order = np.argsort(grams, kind="stable")
    run = grams[order]
    equal = run[1:] == run[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    in_one = np.zeros(len(words), bool)
    for i in range(3):
        in_one[i: i + len(grams)] |= twice
    return int(in_one.sum())


def counts(col) -> dict[str, np.ndarray]:
    """COUNTS of each row of an Arrow string column; nulls are empty."""
    data, off = tk.flat_utf8(col)
    n = len(off) - 1
    out = {c: np.zeros(n, np.int64) for c in COUNTS}
    for lo, hi in tk.slices(off):
        part, o = data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        if not len(part):
            continue
        starts, ends, at = tk.pieces(part, o, tk.SPACE)
        h = tk.piece_hashes(part, starts, ends)
        l_start, l_end, _ = tk.pieces(part, o, tk.NEWLINE)
        word_at = np.searchsorted(starts, l_start)
        worded = word_at < np.searchsorted(starts, l_end)
        l_start, l_end = l_start[worded], l_end[worded]
        line_hash, line_at = tk.piece_hashes(part, l_start, l_end), np.searchsorted(l_start, o)
        long_word = np.concatenate(([0], np.cumsum(ends - starts >= 20)))
        row = {
            "n_words": np.diff(at), "n_lines": np.diff(line_at),
            "word_chars": tk.row_sums(~tk.SPACE[part] & (part & 0xC0 != 0x80), o),
            "n_long_words": np.diff(long_word[at]),
        }
        for name, lut in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_stops", _STOP),
                          ("n_punct", _PUNCT)):
            row[name] = tk.row_sums(lut[part], o)
        for name, values in row.items():
            out[name][lo:hi] = values
        for i in range(hi - lo):
            words, lines = h[at[i]: at[i + 1]], line_hash[line_at[i]: line_at[i + 1]]
            out["n_distinct_words"][lo + i] = _distinct(words)
            out["n_repeat_words"][lo + i] = _repeated(words)
            out["n_dup_lines"][lo + i] = len(lines) - _distinct(lines)
    return out


def with_counts(df: DataFrame, text: str = "text", prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``df`` and COUNTS (names after ``prefix``) of its text column."""
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            found = counts(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(found[c], pa.int64()) for c in COUNTS)],
                names=[*names, *(prefix + c for c in COUNTS)])

    return df.mapInArrow(run, StructType([*fields, *(StructField(prefix + c, LongType()) for c in COUNTS)]))
