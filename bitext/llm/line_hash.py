"""Line dedup over a sharded minimal perfect hash (operator 12).

A line's key is the line without blanks at its ends, A-Z lower-cased.  Keys of
MIN_CHARS code points or more that MIN_DOCS documents hold lose all their lines
but those in the largest doc_id that holds them.

1. Survey: every document's distinct long keys as 96-bit hashes, written with
   the document's key.  Documents that a task reads together are a block.
2. Count: documents and largest doc_id of each distinct key (distinct pairs of
   key and document first, so a key of a third of all documents lies spread).
3. Index: the keys are dealt to shards by hash.  A task gives each of a shard's
   keys its own number without gaps: level after level, keys that hash to a bit
   of their own take it, the others go on to the next level; the number is the
   rank of the bit.  A fingerprint, a count and a doc_id array, in the order of
   the numbers, are all that is kept; the shard does not hold its keys.
4. Probe: a block asks each shard once for its distinct keys of that shard, as
   one packed record, so a frequent line costs one question a block.  A shard's
   arrays meet its questions in one task, arrays first, questions streamed.
   The answers go back to their blocks in the same manner.  No line is joined
   with a line, and nothing goes through the driver or a broadcast.
5. Cut: documents that lose lines get them as a short list, joined by the
   document's key; the rest keep their text.

A shard holds about SHARD_KEYS keys whatever the input; there are as many
shards as the keys need.  Two keys count as one if 96 bits of hash agree (at
1e11 keys about once in 1e7 runs).

Cases: a null or empty text is one empty line.  Rows that share a doc_id are
one document; each row keeps its own text.  Rows with a null doc_id don't count
as documents and hold no key for others: they lose a line whose key goes.
Lines under MIN_CHARS stay, blank ones included.  Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from bitext.session import materialize

from . import textkit as tk
from .registry import query, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Distinct keys of one shard, about 20 bytes each.
SHARD_KEYS = 1 << 17
#: Bits a level has for each key that reaches it.
ROOM = 2

_SECOND = np.uint64(0xD6E8FEB86659FD93)


def long_lines(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Lines of texts in one byte array whose key has ``min_chars`` code points:
    row, start and end in the array, 64-bit and 32-bit hash of the key."""
    start, end, _ = tk.pieces(data, offsets, tk.NEWLINE)
    ink = np.flatnonzero(~tk.SPACE[data])
    a, b = np.searchsorted(ink, start), np.searchsorted(ink, end)
    some = b > a
    start, end, a, b = start[some], end[some], ink[a[some]], ink[b[some] - 1] + 1
    chars = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
    some = chars[b] - chars[a] >= min_chars
    start, end, a, b = start[some], end[some], a[some], b[some]
    low = tk.LOWER[data]
    h = tk.piece_hashes(low, a, b)
    f = tk.piece_hashes(low ^ np.uint8(0x55), a, b) * _SECOND >> np.uint64(32)
    return np.searchsorted(offsets, start, "right") - 1, start, end, h, f.astype(np.uint32)


# ------------------------------------------------------------- minimal perfect hash
def _place(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
    return (tk.mix64(h + seed * (f.astype(np.uint64) * np.uint64(2) + np.uint64(1))) % np.uint64(size)).astype(np.int64)


def build_index(h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the levels, their bits in 64-bit words) for distinct keys (h, f)."""
    sizes, words, level = [], [np.zeros(0, np.uint64)], 0
    while len(h):
        size = -(-ROOM * len(h) // 64) * 64
        at = _place(h, f, level, size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        rest = ~alone[at]
        h, f, level = h[rest], f[rest], level + 1
    return np.array(sizes, np.int64), np.concatenate(words)


class Index:
    """Number of a key: the rank of its bit.  A foreign key gets any number or -1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def numbers(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        out, todo, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = base + _place(h[todo], f[todo], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.before[at >> 6] + below)[hit]
            todo, base = todo[~hit], base + size
        return out


# ------------------------------------------------------------- tasks
_SURVEY = "block long, k1 long, k2 long, doc_id long, hs binary, fs binary"


def _survey(min_chars: int):
    """(k1, k2, doc_id, text) -> distinct long keys of each row; rows without are left out."""
    schema = pa.schema([("block", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()),
                        ("hs", pa.binary()), ("fs", pa.binary())])

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            data, off = tk.flat_utf8(batch.column(3))
            at, hs, fs = [], [], []
            for lo, hi in tk.slices(off):
                row, _, _, h, f = long_lines(data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo], min_chars)
                order = np.lexsort((f, h, row))
                row, h, f = row[order], h[order], f[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (f[1:] != f[:-1])
                row, h, f = row[new], h[new], f[new]
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
                for a, b in zip(first, [*first[1:], len(row)]):
                    at.append(lo + row[a])
                    hs.append(h[a:b].tobytes())
                    fs.append(f[a:b].tobytes())
            keep = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), (part << 32) + number)), *(batch.column(i).take(keep) for i in range(3)),
                 pa.array(hs, pa.binary()), pa.array(fs, pa.binary())], schema=schema)
    return run


def _flat(col: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of packed arrays, and where each row's begin."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    size = np.dtype(kind).itemsize
    if data is None or off[-1] == off[0]:
        return np.zeros(0, kind), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, kind, int(off[-1] - off[0]) // size, int(off[0])), (off - off[0]) // size


def _keys(batches):
    """Survey rows -> one row a key and document."""
    for batch in batches:
        h, off = _flat(batch.column("hs"), np.int64)
        f, _ = _flat(batch.column("fs"), np.int32)
        doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(off) - 1), np.diff(off))))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(f), doc], names=["h", "f", "doc_id"])


_SHARD = "shard int, block long, sizes binary, words binary, prints binary, counts binary, keepers binary, hs binary, fs binary"
_BLANK = b""


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(33)) * np.uint64(shards) >> np.uint64(31)).astype(np.int32)


def _build(key, t):
    """A shard's keys -> its arrays."""
    h, f = (t[c].combine_chunks().to_numpy() for c in ("h", "f"))
    h, f = h.view(np.uint64), f.view(np.uint32)
    sizes, words = build_index(h, f)
    order = np.empty(len(h), np.int64)
    order[Index(sizes, words).numbers(h, f)] = np.arange(len(h))
    counts, keepers = (t[c].combine_chunks().to_numpy() for c in ("n", "keeper"))
    return _record([key[0].as_py()], [-1], [sizes.tobytes()], [words.tobytes()], [f[order].tobytes()],
                   [np.minimum(counts[order], 2**31 - 1).astype(np.int32).tobytes()], [keepers[order].tobytes()],
                   [_BLANK], [_BLANK])


def _record(shard, block, *columns):
    return pa.table([pa.array(shard, pa.int32()), pa.array(block, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)],
                    names=["shard", "block", "sizes", "words", "prints", "counts", "keepers", "hs", "fs"])


def _questions(shards: int):
    """Survey rows -> for each block and shard its distinct keys."""
    def ask(block, h, f):
        h, f = np.concatenate(h), np.concatenate(f)
        order = np.lexsort((f, h))
        h, f = h[order], f[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
        h, f = h[new], f[new]
        s = _shard_of(h, shards)
        order = np.argsort(s, kind="stable")
        s, h, f = s[order], h[order], f[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        last = [*first[1:], len(s)]
        none = [_BLANK] * len(first)
        return _record(s[first], [block] * len(first), *[none] * 5, [h[a:b].tobytes() for a, b in zip(first, last)],
                       [f[a:b].tobytes() for a, b in zip(first, last)]).to_batches()

    def run(batches):
        now, hs, fs = None, [], []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            h, off = _flat(batch.column("hs"), np.int64)
            f, _ = _flat(batch.column("fs"), np.int32)
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if blocks[a] != now and hs:
                    yield from ask(now, hs, fs)
                    hs, fs = [], []
                now = int(blocks[a])
                hs.append(h[off[a]: off[b]])
                fs.append(f[off[a]: off[b]])
        if hs:
            yield from ask(now, hs, fs)
    return run


_ANSWER = "block long, hs binary, fs binary, keepers binary"


def _answers(min_docs: int):
    """A shard's arrays, then its questions -> of each question the keys that
    ``min_docs`` documents hold, with the doc_id that keeps them."""
    schema = pa.schema([("block", pa.int64()), ("hs", pa.binary()), ("fs", pa.binary()), ("keepers", pa.binary())])

    def run(batches):
        held = index = prints = counts = keepers = None
        for batch in batches:
            out, shards = [[], [], [], []], batch.column("shard").to_numpy()
            for i in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)  # noqa: B023, E731
                block = batch.column("block")[i].as_py()
                if block < 0:
                    index = Index(get("sizes", np.int64), get("words", np.uint64))
                    prints, counts, keepers = get("prints", np.uint32), get("counts", np.int32), get("keepers", np.int64)
                    held = shards[i]
                    continue
                if shards[i] != held:  # no document with an id has a key of this shard
                    continue
                h, f = get("hs", np.uint64), get("fs", np.uint32)
                at = index.numbers(h, f)
                known = (at >= 0) & (prints[at] == f) & (counts[at] >= min_docs)
                if known.any():
                    for col, v in zip(out, (block, h[known].tobytes(), f[known].tobytes(), keepers[at[known]].tobytes())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)
    return run


def _find(h: np.ndarray, f: np.ndarray, kh: np.ndarray, kf: np.ndarray) -> np.ndarray:
    """Place of each key (h, f) among the keys (kh, kf), which are sorted by kh, or -1."""
    out = np.full(len(h), -1, np.int64)
    at, end = np.searchsorted(kh, h), np.searchsorted(kh, h, "right")
    for step in range(int((end - at).max(initial=0))):  # more than one only where 64 bits agree
        j = np.minimum(at + step, len(kh) - 1)
        hit = (at + step < end) & (kf[j] == f)
        out[hit] = j[hit]
    return out


_DROP = "k1 long, k2 long, hs binary, fs binary"


def _drops(batches):
    """A block's answers, then its documents -> the keys each one loses."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("hs", pa.binary()), ("fs", pa.binary())])
    now, known, sorted_ = None, [], None
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("answer").to_pylist()
        k1, k2, docs = (batch.column(c).to_pylist() for c in ("k1", "k2", "doc_id"))
        out = [[], [], [], []]
        for i in range(batch.num_rows):
            get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)  # noqa: B023, E731
            if blocks[i] != now:
                now, known, sorted_ = blocks[i], [], None
            if kinds[i]:
                known.append((get("hs", np.uint64), get("fs", np.uint32), get("keepers", np.int64)))
                continue
            if not known:
                continue
            if sorted_ is None:
                kh, kf, kk = (np.concatenate(x) for x in zip(*known))
                order = np.argsort(kh, kind="stable")
                sorted_ = kh[order], kf[order], kk[order]
            h, f = get("hs", np.uint64), get("fs", np.uint32)
            at = _find(h, f, *sorted_[:2])
            gone = (at >= 0) & ((sorted_[2][at] != docs[i]) if docs[i] is not None else True)
            if gone.any():
                for col, v in zip(out, (k1[i], k2[i], h[gone].tobytes(), f[gone].tobytes())):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)


def _cut(min_chars: int):
    """(doc_id, text, lost keys) -> text without their lines."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def run(batches):
        for batch in batches:
            data, off = tk.flat_utf8(batch.column("text"))
            breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
            n_lines = breaks[off[1:]] - breaks[off[:-1]] + 1
            dropped = np.zeros(batch.num_rows, np.int64)
            lost, prints = batch.column("hs"), batch.column("fs")
            texts = []
            for i in range(batch.num_rows):
                text = data[off[i]: off[i + 1]]
                if lost[i].is_valid:
                    kh, kf = np.frombuffer(lost[i].as_py(), np.uint64), np.frombuffer(prints[i].as_py(), np.uint32)
                    order = np.argsort(kh, kind="stable")
                    _, start, _, h, f = long_lines(text, np.array([0, len(text)]), min_chars)
                    gone = _find(h, f, kh[order], kf[order]) >= 0
                    line = breaks[off[i] + start[gone]] - breaks[off[i]]
                    dropped[i] = len(line)
                    away = set(line.tolist())
                    texts.append(b"\n".join(x for j, x in enumerate(text.tobytes().split(b"\n")) if j not in away))
                else:
                    texts.append(text.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines), pa.array(dropped)],
                schema=schema)
    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Per row of ``docs``: doc_id, text (what is left), n_lines (before), n_dropped."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    docs = docs.select(F.xxhash64(doc, text).alias("k1"), F.xxhash64(F.lit(1), doc, text).alias("k2"),
                       doc.alias("doc_id"), text.alias("text"))
    held = materialize(docs.mapInArrow(_survey(min_chars), _SURVEY), "lines-survey")
    pairs = held.filter("doc_id is not null").mapInArrow(_keys, "h long, f int, doc_id long").distinct()
    keys = materialize(pairs.groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")), "lines-keys")
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // shard_keys))
    shard = F.shiftright(F.shiftrightunsigned("h", 33) * shards, 31).cast("int").alias("shard")
    arrays = materialize(keys.groupBy(shard).applyInArrow(_build, _SHARD), "lines-shards")
    asked = held.mapInArrow(_questions(shards), _SHARD)
    answers = materialize(
        arrays.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "block")
        .mapInArrow(_answers(min_docs), _ANSWER), "lines-answers")
    none = F.lit(None)
    both = answers.select("block", F.lit(True).alias("answer"), none.cast("long").alias("k1"), none.cast("long").alias("k2"),
                          none.cast("long").alias("doc_id"), "hs", "fs", "keepers").unionByName(
        held.select("block", F.lit(False).alias("answer"), "k1", "k2", "doc_id", "hs", "fs", F.lit(b"").alias("keepers")))
    drops = (both.repartition("block").sortWithinPartitions("block", F.desc("answer"))
             .mapInArrow(_drops, _DROP).dropDuplicates(["k1", "k2"]))
    return docs.join(materialize(drops, "lines-drops"), ["k1", "k2"], "left").select("doc_id", "text", "hs", "fs").mapInArrow(
        _cut(min_chars), "doc_id long, text string, n_lines long, n_dropped long")


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id IS DISTINCT FROM g.keeper AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""


@query("op12_line_hash", sql=_ORACLE)
def op12(spark, sf_dir: str) -> DataFrame:
    """Contract: keys of 40 code points in 5 documents."""
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
