"""Exact removal of repeated byte strings (operator 3).

A byte goes when a LENGTH-byte string that covers it also starts somewhere
else in the collection.  The strings that repeat are found by building the
positional Burrows-Wheeler order of many texts column by column:

* Every LENGTH-byte string has an anchor: its KEY-byte string of least hash
  (the first on ties).  Equal strings have equal anchors at equal places, so
  only texts around an anchor that occurs twice can repeat.  Anchors are
  counted over the whole collection.
* Around each such anchor, the bytes of all strings that have it form one
  segment.  Segments of one anchor are dealt to one task and lie with their
  anchors in one column.
* From the last column to the first, every round inserts one symbol in front
  of each segment's suffix.  The order of the suffixes (the permutation behind
  the collection's transform) is updated by one stable pass over the symbols,
  and the common prefix of neighbours by range minima over the old ones.  The
  columns are a file, written once and read one column a round; only order and
  prefixes stay in memory.  Neighbours that agree in LENGTH symbols are two
  starts of one string.

Why not every suffix of the whole collection in one order, as short reads
allow: with one symbol per document a round, rounds equal the longest text and
each reads what all earlier ones wrote.  Anchors bound the rounds at
2 * LENGTH - KEY and let tasks work apart, with equal results.

Texts that occur more than once are built once and counted; a text's repeated
segments are recognised where they are cut, so periodic texts stay linear.

On request the same order is built with words as symbols: n_shared_words is
the number of a text's words in a passage of ``words`` words that another row
has too, whatever the white space and the case of A-Z.  It only reports;
nothing goes for it.  Word anchors are odd, byte anchors even numbers.

Cases: null texts are empty; texts under LENGTH bytes lose nothing unless a
parameter says less; repeated rows are texts that occur twice; null doc_ids
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.session import materialize

from . import textkit as tk
from .registry import query, table

LENGTH, KEY = 400, 48
#: Passages of over 50 words, and the words of their anchors.
WORDS, WORD_KEY = 51, 8
#: Segments that a task builds together (whole groups; a larger group alone).
CHUNK = 32_768
#: Segments of one anchor that one task builds.  Strings of a more frequent
#: anchor are counted by their hash instead, which any number of tasks can do.
MAX_GROUP = 100_000
#: Bits of the bitmap that keeps texts out of a shuffle (4 MB, broadcast).
BITS = 1 << 25
_PAD = 0xFF  # never a UTF-8 byte

_BYTE = (tk.mix64(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_STEP = (tk.mix64(np.arange(400, 416, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """32-bit hash of each run of ``size`` bytes, by doubling."""
    n = len(data) - size + 1
    power, width, out, done, level = _BYTE[data], 1, None, 0, 0
    while True:
        if size & width:
            out = power[:n].copy() if out is None else out * _STEP[level] + power[done: done + n]
            done += width
        if done == size:
            break
        power = power[: len(power) - width] * _STEP[level] + power[width:]
        width, level = width * 2, level + 1
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def _least(grams: np.ndarray, offsets: np.ndarray, length: int, key: int):
    """Row, place, and first and last start of each anchor, where ``grams``
    hashes the runs of ``key`` symbols of all rows."""
    n = len(grams) + key - length
    if n <= 0:
        return [np.zeros(0, np.int64)] * 4
    # smallest (hash, place) of each run of length - key + 1 places
    span, best = length - key + 1, (grams.astype(np.uint64) << np.uint64(32))
    best |= np.arange(len(best), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    best = np.minimum(best[:n], best[span - width: span - width + n])
    place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    good = np.arange(n) + length <= offsets[row + 1]
    start = np.flatnonzero(good)
    if not len(start):
        return [np.zeros(0, np.int64)] * 4
    place, row = place[start], row[start]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(new[1:], len(start)) - 1
    return row[new], place[new], start[new], start[last]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, key: int = KEY):
    """For texts in one byte array: row, place, and first and last start (all
    from the text's begin) of each anchor, its even 64-bit hash, and begin and
    end of the bytes around it."""
    grams = _gram_hashes(data, key) if len(data) >= length else np.zeros(0, np.uint32)
    row, place, first, last = _least(grams, offsets, length, key)
    base, hashes = offsets[row], tk.piece_hashes(data, place, place + key) & ~np.uint64(1)
    return row, place - base, first - base, last - base, hashes, first - base, last - base + length


def word_anchors(low: np.ndarray, offsets: np.ndarray, words: int, key: int = WORD_KEY):
    """Like ``anchors`` for the words of lower-cased texts, hashes odd; begin
    and end count bytes, the rest counts words.  And each row's words."""
    starts, ends, at = tk.pieces(low, offsets, tk.SPACE)
    key = min(key, words - 1)
    grams = tk.windows(tk.piece_hashes(low, starts, ends), key)
    row, place, first, last = _least((grams >> np.uint64(32)).astype(np.uint32), at, words, key)
    base, of = at[row], offsets[row]
    found = (row, place - base, first - base, last - base, grams[place] | np.uint64(1),
             starts[first] - of, ends[last + words - 1] - of)
    return found, np.diff(at)


def _texts(col, length: int, key: int, words: int | None = None):
    """(text bytes, number of words, (bytes, its anchors) for bytes and, on
    request, words) of each row of a string column."""
    data, off = tk.flat_utf8(col)
    for lo, hi in tk.slices(off):
        part, o = data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        kinds, n_words = [(part, anchors(part, o, length, key))], np.zeros(hi - lo, np.int64)
        if words:
            low = tk.LOWER[part]
            found, n_words = word_anchors(low, o, words)
            kinds.append((low, found))
        at = [np.searchsorted(row, np.arange(hi - lo + 1)) for _, (row, *_) in kinds]
        for i in range(hi - lo):
            yield part[o[i]: o[i + 1]], int(n_words[i]), [
                (source[o[i]: o[i + 1]], *(x[a[i]: a[i + 1]] for x in rest)) for a, (source, (_, *rest)) in zip(at, kinds)]


def _survey(length: int, key: int, words: int | None = None):
    """(doc_id, h, g, text) -> per row its size, digest and anchors, each with
    the number of segments that ``_segments`` would send for it (2 at least
    when the text has it more than once), and its number of words."""
    def run(batches):
        for batch in batches:
            sizes, digests, ends, n_words = [], [], [0], []
            flat, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for text, n, kinds in _texts(batch.column(3), length, key, words):
                sizes.append(len(text))
                digests.append(hashlib.sha256(text).hexdigest())
                n_words.append(n)
                ends.append(ends[-1])
                for source, place, first, last, hashes, begin, end in kinds:
                    found, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
                    often = np.flatnonzero(times[which] > 2)
                    if len(often):  # equal segments are sent once
                        segment = tk.piece_hashes(source, begin[often], end[often])
                        segment ^= tk.mix64((place - first)[often].astype(np.uint64))
                        differ = np.unique(np.rec.fromarrays((which[often], segment)))
                        times = np.minimum(times, 2)
                        times = np.maximum(times, np.bincount(differ.f0, minlength=len(found)))
                    flat.append(found)
                    counts.append(times)
                    ends[-1] += len(found)
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(flat).view(np.int64)),
                                               pa.array(np.concatenate(counts).astype(np.int32))], ["anchor", "n"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), lists,
                 pa.array(n_words, pa.int64())],
                names=["doc_id", "h", "g", "n_bytes", "digest", "anchors", "n_words"])
    return run


_SEGMENT = pa.schema([("anchor", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("place", pa.int64()),
                      ("first", pa.int64()), ("last", pa.int64()), ("bytes", pa.binary()),
                      ("others", pa.list_(pa.int64()))])


def _segments(length: int, key: int, words: int | None = None):
    """(h, g, text, wanted anchor hashes) -> segments.  One that its own text
    repeats is sent once; all its places are known to repeat (bytes null), or,
    of words, its other places go with it, as distances from the first."""
    def run(batches):
        for batch in batches:
            hs, gs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wanted, out, held = batch.column(3), [], 0
            for i, (_, _, kinds) in enumerate(_texts(batch.column(2), length, key, words)):
                want, known = wanted[i].values.to_numpy().view(np.uint64), []
                for source, place, first, last, hashes, begin, end in kinds:
                    seen: dict[tuple, list] = {}
                    for j in np.flatnonzero(np.isin(hashes, want)):
                        a, lo, hi = int(place[j]), int(first[j]), int(last[j])
                        seg = source[begin[j]: end[j]].tobytes()
                        seen.setdefault((int(hashes[j].view(np.int64)), a - lo, seg), []).append((a, lo, hi))
                    for (anchor, _, seg), places in seen.items():
                        others = [lo - places[0][1] for _, lo, _ in places[1:]] if anchor & 1 else []
                        out.append((anchor, hs[i], gs[i], *places[0], seg, others))
                        if len(places) > 1 and not anchor & 1:
                            known += [(lo, hi) for _, lo, hi in places]
                        held += len(seg)
                out += [(hs[i], hs[i], gs[i], lo, lo, hi, None, None) for lo, hi in _joined(sorted(known))]
                if held > 1 << 24:
                    yield _batch(out, _SEGMENT)
                    out, held = [], 0
            yield _batch(out, _SEGMENT)
    return run


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs of starts, neighbours made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in runs:
        if out and lo <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


_STRING = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("start", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                     ("words", pa.bool_())])


def _strings(length: int, key: int, words: int | None = None):
    """(h, g, text, wanted anchor hashes) -> every string of these anchors, as
    its start and 96 bits of hashes (of words, 128)."""
    def run(batches):
        for batch in batches:
            hs, gs, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for i, (_, n_words, kinds) in enumerate(_texts(batch.column(2), length, key, words)):
                want = wanted[i].values.to_numpy().view(np.uint64)
                for k, (source, _, first, last, hashes, *_) in enumerate(kinds):
                    these = np.flatnonzero(np.isin(hashes, want))
                    if not len(these):
                        continue
                    if k:
                        each = tk.piece_hashes(source, *tk.pieces(source, np.array([0, len(source)]), tk.SPACE)[:2])
                        grams, other = tk.windows(each, words), tk.windows(tk.mix64(each), words)
                    else:
                        grams = _gram_hashes(source, length)
                    for j in these:
                        start = np.arange(first[j], last[j] + 1)
                        s1 = other[start] if k else tk.piece_hashes(source, start, start + length)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(start), x)) for x in (hs[i], gs[i])] + [pa.array(x) for x in (
                                start, s1.view(np.int64), grams[start].astype(np.int64), np.full(len(start), bool(k)))],
                            schema=_STRING)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def repeated_starts(columns, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int,
                    symbols: int = 256, owner: np.ndarray | None = None):
    """Rounds over ``columns`` (columns x segments), last to first.  ``group``
    numbers the segments' groups, ascending; starts of segment e are columns
    lo[e] to hi[e].  Returns runs (segment, first column, last column) of
    starts whose ``length`` symbols another segment of the group also has, with
    ``owner`` one of another owner."""
    width, n = columns.shape
    order = np.arange(n)
    fence = np.concatenate(([True], group[1:] != group[:-1]))  # a group's first place
    differ = np.where(fence, -1, width).astype(np.int64)  # column of the first difference with the one before
    seen, high = np.full(n, -2, np.int64), np.full(n, -2, np.int64)
    runs = []

    def close(e):
        e = e[seen[e] >= 0]
        runs.append((e, seen[e], high[e]))

    for r in range(width - 1, -1, -1):
        rank = group * symbols + np.asarray(columns[r])[order]
        if (rank[1:] < rank[:-1]).any():
            p = np.argsort(rank, kind="stable")
            rank = rank[p]
            same = np.concatenate(([False], rank[1:] == rank[:-1]))
            new = np.where(same, differ[p], r)
            far = np.flatnonzero(same[1:] & (p[1:] != p[:-1] + 1)) + 1
            if len(far):
                pairs = np.column_stack((p[far - 1] + 1, p[far] + 1)).ravel()
                new[far] = np.minimum.reduceat(np.append(differ, width), pairs)[::2]
            order, differ = order[p], new
        else:
            differ[1:][rank[1:] != rank[:-1]] = r
        differ[fence] = -1
        like = np.flatnonzero(differ - r >= length)
        if len(like):
            at = np.union1d(like, like - 1)
            e = order[at]
            if owner is not None:  # keep strings of more than one owner
                new = differ[at] - r < length
                string = np.cumsum(new) - 1
                mixed = np.zeros(string[-1] + 1, bool)
                mixed[string[1:][~new[1:] & (owner[e][1:] != owner[e][:-1])]] = True
                e = e[mixed[string]]
            e = e[(lo[e] <= r) & (r <= hi[e])]
            fresh = e[seen[e] != r + 1]
            close(fresh)
            high[fresh] = r
            seen[e] = r
    close(np.arange(n))
    return tuple(np.concatenate(x) for x in zip(*runs))


_RUN = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.bool_())])


def _runs(h, g, start, end, words: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, g, start, end, np.full(len(h), words))], schema=_RUN)


def _word_ranges(t: pa.Table, words: int, key: int = WORD_KEY) -> pa.RecordBatch:
    """Segments of words sorted by anchor -> ranges of words that another text
    has too."""
    n, left = len(t), words - min(key, words - 1)
    _, group = np.unique(t["anchor"].to_numpy(), return_inverse=True)
    place, first, last, h, g = (t[c].to_numpy() for c in ("place", "first", "last", "h", "g"))
    columns = np.zeros((left + words, n), np.uint64)
    at = 0
    for piece in t["bytes"].chunks:
        for lo in range(0, len(piece), 2048):
            part = piece.slice(lo, 2048)
            _, off, data = part.buffers()
            off = np.frombuffer(off, np.int32)[part.offset: part.offset + len(part) + 1].astype(np.int64)
            data, off = np.frombuffer(data, np.uint8)[off[0]: off[-1]], off - off[0]
            starts, ends, rows = tk.pieces(data, off, tk.SPACE)
            e = np.repeat(np.arange(len(part)), np.diff(rows))
            begin = (left - (place - first))[at: at + len(part)]
            columns[np.arange(len(starts)) - rows[e] + begin[e], e + at] = tk.piece_hashes(data, starts, ends)
            at += len(part)
    for r in range(len(columns)):  # only symbols of one column are compared
        columns[r] = np.unique(columns[r], return_inverse=True)[1]
    owner = np.unique(np.rec.fromarrays((h, g)), return_inverse=True)[1]
    e, a, b = repeated_starts(columns.view(np.int64), group, left - place + first, left - place + last, words, n, owner)
    start, size = a + place[e] - left, b - a + words
    others = t["others"].combine_chunks()
    many = pa.compute.list_value_length(others).to_numpy()[e]
    begin = others.offsets.to_numpy()[e] - others.offsets[0].as_py()
    more = np.repeat(np.arange(len(e)), many)
    inner = np.arange(len(more)) - np.repeat(np.cumsum(many) - many, many)
    away = others.flatten().to_numpy()[begin[more] + inner]
    which = np.concatenate((np.arange(len(e)), more))
    start = np.concatenate((start, start[more] + away))
    return _runs(h[e][which], g[e][which], start, start + size[which], True)


def _build(length: int, key: int, chunk: int, words: int | None = None):
    """Segments sorted by anchor -> ranges of bytes and words that repeat."""
    left = length - key

    def ranges(t: pa.Table):
        odd = pa.compute.equal(pa.compute.bit_wise_and(t["anchor"], 1), 1)
        some = t.filter(pa.compute.invert(odd))
        if len(some):
            yield byte_ranges(some)
        some = t.filter(odd)
        if len(some):
            yield _word_ranges(some, words)

    def byte_ranges(t: pa.Table) -> pa.RecordBatch:
        n = len(t)
        _, group = np.unique(t["anchor"].to_numpy(), return_inverse=True)
        place, first, last = (t[c].to_numpy() for c in ("place", "first", "last"))
        with tempfile.TemporaryFile() as file:
            columns = np.memmap(file, np.uint8, "w+", shape=(left + length, n))
            at = 0
            for piece in t["bytes"].chunks:
                for lo in range(0, len(piece), 2048):
                    part = piece.slice(lo, 2048)
                    block = np.full((len(part), left + length), _PAD, np.uint8)
                    for i, v in enumerate(part):
                        e = at + i
                        v = np.frombuffer(v.as_buffer(), np.uint8)
                        begin = left - (place[e] - first[e])
                        block[i, begin: begin + len(v)] = v
                    columns[:, at: at + len(part)] = block.T
                    at += len(part)
            e, a, b = repeated_starts(columns, group, left - place + first, left - place + last, length)
            del columns
        shift = place[e] - left
        h, g = t["h"].to_numpy(), t["g"].to_numpy()
        return _runs(h[e], g[e], a + shift, b + shift + length, False)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            known = t.filter(pa.compute.is_null(t["bytes"]))
            yield _runs(*(known[c].to_numpy() for c in ("h", "g", "first")), known["last"].to_numpy() + length, False)
            t = t.filter(pa.compute.is_valid(t["bytes"]))
            if not len(t):
                continue
            if size >= chunk:  # at a border between groups, build what is held
                keys = t["anchor"].to_numpy()
                cut = int(np.searchsorted(keys != held[-1]["anchor"][-1].as_py(), True)) if len(keys) else 0
                held.append(t.slice(0, cut))
                t = t.slice(cut)
                if len(t):
                    yield from ranges(pa.concat_tables(held))
                    held, size = [], 0
            if len(t):
                held.append(t)
                size += len(t)
        if size:
            yield from ranges(pa.concat_tables(held))
    return run


_CUT = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("cut_removed", pa.int64()), ("cut_spans", pa.int64()),
                  ("cut_digest", pa.string()), ("cut_words", pa.int64())])


def _covered(spans, size: int) -> np.ndarray:
    """Which of ``size`` places the spans cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, spans.field(0).to_numpy(), 1)
    np.add.at(edge, spans.field(1).to_numpy(), -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches):
    """(h, g, text, ranges) -> what is left of the text."""
    for batch in batches:
        data, off = tk.flat_utf8(batch.column(2))
        rows = []
        for i, (h, g, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3))):
            text = data[off[i]: off[i + 1]]
            spans = found.values
            gone = _covered(spans.filter(pa.compute.invert(spans.field(2))), len(text))
            shared = _covered(spans.filter(spans.field(2)), len(text))  # a text has fewer words than bytes
            starts = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
            rows.append((h, g, int(gone.sum()), starts, hashlib.sha256(text[~gone].tobytes()).hexdigest(), int(shared.sum())))
        yield _batch(rows, _CUT)


def _perhaps_in(docs: DataFrame, some: DataFrame) -> DataFrame:
    """``docs`` without most rows whose h is not in ``some``, and with all
    others: a join after it shuffles few texts that it would drop."""
    at = F.pmod(F.col("h"), F.lit(BITS)) + 1  # bitmap functions count from 1
    bits = (some.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
            .repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    byte = F.substring("bits", (F.shiftright(F.bitmap_bit_position(at), 3) + 1).cast("int"), F.lit(1))
    mask = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (F.bitmap_bit_position(at) % 8 + 1).cast("int"))
    return (docs.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "bucket")
            .filter(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(mask) > 0).select(docs.columns))


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: int = KEY, chunk: int = CHUNK,
                   max_group: int = MAX_GROUP, words: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256
    and, with ``words``, n_shared_words."""
    if not 0 < key < length:
        raise ValueError("the anchor must be shorter than the string")
    if words is not None and words < 2:
        raise ValueError("a passage must have two words at least")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"),
                       F.xxhash64(F.lit(1), text).alias("g"), text.alias("text"))
    rows = materialize(docs.mapInArrow(_survey(length, key, words),
                                       "doc_id long, h long, g long, n_bytes long, digest string, "
                                       "anchors array<struct<anchor: long, n: int>>, n_words long"), "bwt-survey")
    once = rows.select("h", "g", "anchors").dropDuplicates(["h", "g"]).select(F.inline("anchors"))
    found = rows.select("h", "g", F.inline("anchors")).drop("n")  # a text's copies are made one by the set of wanted
    of_words = F.col("anchor").bitwiseAND(1) == 1  # these must be in two texts
    twice = materialize(once.groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
                        .filter(F.when(of_words, F.col("texts")).otherwise(F.col("n")) > 1)
                        .select("anchor", (F.col("n") > max_group).alias("hot")), "bwt-anchors")

    def around(some: DataFrame) -> DataFrame:
        wanted = materialize(found.join(some.select("anchor"), "anchor").groupBy("h", "g")
                             .agg(F.collect_set("anchor").alias("wanted")), "bwt-wanted")
        texts = _perhaps_in(docs.select("h", "g", "text"), wanted).groupBy("h", "g").agg(F.first("text").alias("text"))
        return texts.join(wanted, ["h", "g"]).select("h", "g", "text", "wanted")

    segments = around(twice.filter("not hot")).mapInArrow(
        _segments(length, key, words), "anchor long, h long, g long, place long, first long, last long, bytes binary, "
                                       "others array<long>")
    repeated = (segments.repartition("anchor").sortWithinPartitions("anchor")
                .mapInArrow(_build(length, key, chunk, words), "h long, g long, start long, end long, words boolean"))
    if twice.filter("hot").limit(1).count():
        strings = materialize(around(twice.filter("hot")).mapInArrow(
            _strings(length, key, words), "h long, g long, start long, s1 long, s2 long, words boolean"), "bwt-strings")
        often = strings.groupBy("words", "s1", "s2").agg(
            F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{f.__name__}") for c in "hg" for f in (F.min, F.max)))
        often = often.filter("n > 1 and (not words or h_min != h_max or g_min != g_max)").select("words", "s1", "s2")
        repeated = repeated.unionByName(strings.join(often, ["words", "s1", "s2"]).select(
            "h", "g", "start", (F.col("start") + F.when(F.col("words"), words or 0).otherwise(length)).alias("end"), "words"))
    ranges = materialize(repeated.groupBy("h", "g").agg(
        F.collect_list(F.struct("start", "end", "words")).alias("ranges")), "bwt-ranges")
    cuts = (_perhaps_in(docs.select("h", "g", "text"), ranges).join(ranges, ["h", "g"]).groupBy("h", "g")
            .agg(F.first("text").alias("text"), F.first("ranges").alias("ranges"))
            .mapInArrow(_cut, "h long, g long, cut_removed long, cut_spans long, cut_digest string, cut_words long"))
    copies = rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("copies"))
    info = materialize(copies.join(cuts, ["h", "g"], "left"), "bwt-cuts")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = [
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("cut_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("cut_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("cut_digest", "digest")).alias("kept_sha256")]
    if words:
        whole = (F.col("copies") > 1) & (F.col("n_words") >= words)
        out.append(F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long")
                   .alias("n_shared_words"))
    return rows.select("doc_id", "h", "g", "n_bytes", "digest", "n_words").join(info, ["h", "g"]).select(*out)


@query("op3_column_bwt")
def op3(spark, sf_dir: str) -> DataFrame:
    """Contract: 400-byte strings.  And words in shared passages of over 50."""
    return remove_repeats(table(spark, sf_dir, "documents"), words=WORDS)
