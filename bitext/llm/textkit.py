"""Vectorised text helpers for Arrow tasks.

They work on the UTF-8 buffer of a whole Arrow column: words, lines and
shingles become offset and hash arrays, with no Python object per word.
Words are ``[^\\x20\\x09-\\x0D]+``.  Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at a time (a longer text stands alone).
SLICE_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def flat_utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [a, b) of about ``limit`` bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def pieces(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray):
    """Non-empty runs without separator bytes, cut at row borders: their
    starts, ends, and for each row the range of its pieces."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~sep[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = True
    last[cut - 1] = True
    starts = np.flatnonzero(first & inside)
    ends = np.flatnonzero(last & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    where = np.arange(int(size.sum()), dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    inner = where - np.repeat(begin, size)
    value = (data[inner + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[inner]
    return mix64(np.add.reduceat(value, begin) ^ (size.astype(np.uint64) << np.uint64(40)))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of each run of k consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix64(out + np.uint64(i + 1)) ^ hashes[i: i + n]
    return mix64(out + np.uint64(k << 8))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words: the sequence as one."""
    if not len(hashes):
        return hashes
    if len(hashes) < k:
        return windows(hashes, len(hashes))
    return np.unique(windows(hashes, k))


def row_sums(mask: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Number of true bytes in each row."""
    at = offsets.tolist()
    return [np.count_nonzero(mask[a:b]) for a, b in zip(at, at[1:])]

_PLAIN = LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def plain_utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Like flat_utf8, lower-cased, with ASCII punctuation as spaces."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    data, off = flat_utf8(pc.utf8_lower(col.cast(pa.large_string())))
    return _PLAIN[data], off


#: Scripts written without spaces between words.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def apart(col):
    """A string column with each character of a script without spaces set
    apart by blanks, so that it is a word of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (flat_utf8(col)[0] >= 0xE0).any():
        return col  # all those scripts lie beyond U+0800
    return pc.replace_substring_regex(col.cast(pa.large_string()), _UNSPACED, r" \1 ")


def plain_words(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text, read as plain_utf8."""
    data, off = plain_utf8(apart(pa.array(texts, pa.large_string())))
    starts, ends, at = pieces(data, off, SPACE)
    h = piece_hashes(data, starts, ends)
    return [h[a:b] for a, b in zip(at, at[1:])]
