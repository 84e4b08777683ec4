"""Collocations by dynamic itemset counting (operator 13).

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those
into words ``[^\\x20\\x09]+``.  A phrase is up to MAX_WORDS words in a row within a
piece; everything is counted per language.

Phrases of all lengths are counted at once while the documents are scanned
shard by shard, round and round:

* words are counted from the first step on;
* a longer phrase is active as soon as the phrases without its last and without
  its first word have both reached the threshold, so pairs start after the
  first shard and not after the whole corpus;
* each is counted for one full cycle of shards from its start, wherever in the
  cycle that is; the scan ends when a full cycle brings no new frequent phrase.

Which phrases have reached the threshold before a step is a bitmap of their
hashes of a fixed size (a parameter), the only thing that is broadcast.  Bits are never
cleared, so a phrase is in its cycle just if its two parts pass the bitmap of
now and did not both pass the one a cycle ago, and the bitmaps between tell
since when; no state a phrase is needed.
A part that passes by chance only lets a phrase be counted too early; it still
is counted for one full cycle.  Counts are combined in the task before they are
shuffled, so a phrase of every document is one row a task.

A phrase is known by the hashes of its words but the last and of the last word,
64 bits each.  Frequent words are spelled in a last scan, each from one document
that was kept with its count; longer phrases from their two parts.  What
follows (cuts, scores, phrases inside longer ones, ranks) runs on these counts
with decimals of 38 digits.

Cases: null texts are empty; a null lang is ``und`` (and one with it); repeated
rows count again; texts without words, and pieces shorter than a phrase, add
nothing; ties are ranked by the phrase's UTF-8 bytes; an empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitext.session import materialize

from . import textkit as tk
from .registry import query, table

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2_000
SHARDS = 3
#: Bits of the bitmap of frequent phrases (a power of two).
BITS = 1 << 26
#: Phrases that a task holds before it combines and sends them.
HELD = 4_000_000

_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\x0A\x0B\x0C\x0D")] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros(0, np.uint64)


def phrase_hash(head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words but the last and of the last; a
    word (head 0) keeps its own."""
    return np.where(head == 0, last, tk.mix64(head * _MIX ^ last))


class Words:
    """Words of texts in one byte array: place, hash (with the language's) and
    whether the next word follows in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        self.data = tk.LOWER[data]
        self.start, self.end, self.at = tk.pieces(self.data, offsets, _GAP)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.at))
        self.hash = tk.mix64(tk.piece_hashes(self.data, self.start, self.end) ^ seeds[self.row])
        piece = np.cumsum(_CUT[self.data])[self.start] if len(self.start) else _NONE
        self.glued = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])

    def phrases(self, longest: int, known, older):
        """For each length over 1 the phrases whose parts are ``known``: hash,
        hashes of all but the last word and of the last, and how many of the
        bitmaps before (``older``, newest first) they were reached with."""
        h, at = self.hash, np.arange(len(self.hash))
        full, reach = np.zeros(len(h), np.uint64), np.zeros(len(h), np.int32)
        age = np.full(len(h), len(older), np.int32)
        for k in range(2, longest + 1):
            good = known(h)
            at, h, age = at[good], h[good], age[good]
            here = np.zeros(len(self.hash), bool)
            here[at] = True
            full[at], reach[at] = h, np.minimum(age, sum((m(h).astype(np.int32) for m in older), np.zeros(len(h), np.int32)))
            at = at[at + k - 1 < len(self.hash)]
            at = at[self.glued[at + k - 2] & here[at + 1]]
            head, last, age = full[at], self.hash[at + k - 1], np.minimum(reach[at], reach[at + 1])
            h = phrase_hash(head, last)
            yield k, h, head, last, age


class Bitmap:
    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(64 * len(self.words) - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _texts(batch):
    """Slices of a batch: (Words, first row, end)."""
    data, off = tk.flat_utf8(batch.column("text"))
    seeds = batch.column("seed").to_numpy().view(np.uint64)
    for lo, hi in tk.slices(off, 1 << 20):
        yield Words(data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo], seeds[lo:hi]), lo, hi


_COUNT = pa.schema([("head", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("since", pa.int32()), ("k", pa.int32()),
                    ("doc", pa.int64())])
_COUNT_SQL = "head long, last long, n long, since int, k int, doc long"


def _count(longest: int, step: int, cycle: int, maps: list):
    """(doc, seed, text) -> counts of the active phrases, the step each became
    active, and a document of each word.  ``maps``: broadcast bitmaps of this
    step, the one before, and so on to a cycle ago; what passes them all has
    had its cycle."""
    def packed(held):
        h, *rest = (np.concatenate(x) for x in zip(*held))
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        head, last, since, k, doc = (x[first] for x in rest)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (
            head.view(np.int64), last.view(np.int64), n, since, k, doc)], schema=_COUNT)

    def run(batches):
        known, *older = (Bitmap(m.value) for m in maps)
        held, size = [], 0
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for words, lo, hi in _texts(batch):
                n = len(words.hash)
                if step < cycle:
                    held.append((words.hash, np.zeros(n, np.uint64), words.hash, np.zeros(n, np.int32),
                                 np.ones(n, np.int32), docs[lo:hi][words.row]))
                for k, h, head, last, age in words.phrases(longest, known, older):
                    live = age < cycle
                    held.append((h[live], head[live], last[live], np.int32(step) - age[live],
                                 np.full(int(live.sum()), k, np.int32), np.zeros(int(live.sum()), np.int64)))
                    size += int(live.sum())
                size += n
                if size > HELD:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)
    return run


def _hashed(batches):
    """Rows with head and last -> the phrase's hash in front."""
    for batch in batches:
        head, last = (batch.column(c).to_numpy().view(np.uint64) for c in ("head", "last"))
        yield pa.RecordBatch.from_arrays([pa.array(phrase_hash(head, last).view(np.int64)), *batch.columns],
                                         names=["h", *batch.schema.names])


def _bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the column h; at most bits / 64 rows come to the driver."""
    rows = (hashes.groupBy(F.expr(f"shiftright(h & {bits - 1}, 6)").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("ones")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["ones"].to_numpy().view(np.uint64)
    return out


def _spell(places):
    """(doc, lang, seed, text) -> the words that are looked for in this
    document, and the number of words of each language (h null)."""
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        wanted = Bitmap(places.value)
        for batch in batches:
            langs, docs, out, sizes = batch.column("lang").to_pylist(), batch.column("doc").to_numpy(), [], Counter()
            for words, lo, hi in _texts(batch):
                for lang, n in zip(langs[lo:hi], np.diff(words.at).tolist()):
                    if n:
                        sizes[lang] += n
                at = np.flatnonzero(wanted(words.hash ^ docs[lo:hi][words.row].view(np.uint64)))
                for i in at[np.unique(words.hash[at], return_index=True)[1]].tolist():
                    out.append((int(words.hash[i].view(np.int64)), langs[lo + words.row[i]],
                                words.data[words.start[i]: words.end[i]].tobytes().decode(), None))
            out += [(None, lang, None, n) for lang, n in sizes.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*out)) or [[]] * 4, schema)], schema=schema)
    return run


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS, shards: int = SHARDS,
                     bits: int = BITS) -> DataFrame:
    """(lang, k, phrase, n): counts of all phrases of 1 to ``longest`` words
    that occur ``min_count`` times in a language; k = 0 has its number of words."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(F.xxhash64(F.lit(7), "doc_id", "text").alias("doc"), lang.alias("lang"), F.xxhash64(lang).alias("seed"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    steps, done, maps, sent = [], [], [np.zeros(bits // 64, np.uint64)], []
    while True:
        t = len(steps)
        if t >= shards and (maps[t] == maps[t - shards]).all():
            break  # a full cycle without a new frequent phrase: none is active
        sent.append(spark.sparkContext.broadcast(maps[t]))
        if t > shards:
            sent[t - shards - 1].unpersist()
        counts = docs.filter(F.pmod("doc", F.lit(shards)) == t % shards).select("doc", "seed", "text").mapInArrow(
            _count(longest, t, shards, sent[t::-1][: shards + 1]), _COUNT_SQL)
        summed = [F.sum("n").alias("n"), F.min("since").alias("since"), F.min("k").alias("k"), F.min("doc").alias("doc")]
        # dealt out before any sum: a task's phrases are distinct already
        steps.append(materialize(counts.repartition("head", "last").groupBy("head", "last").agg(*summed), "phrases-step"))
        # what is in its cycle now was counted in its last steps only
        total, *others = [s.filter(F.col("since") > t - shards) for s in steps[-shards:]]
        for s in others:
            total = total.unionByName(s)
        if others:
            total = total.groupBy("head", "last").agg(*summed)
        often = materialize(total.filter(F.col("n") >= min_count).mapInArrow(_hashed, "h long, " + _COUNT_SQL), "phrases-often")
        maps.append(_bits(often.filter(F.col("k") < longest).select("h"), bits) | maps[t])
        done.append(often.filter(F.col("since") == t - shards + 1))  # their cycle ends with this step
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    # words are spelled from the one document kept with each, phrases from their parts
    place = whole.filter("k = 1").select(F.col("h").bitwiseXOR(F.col("doc")).alias("h"))
    read = materialize(docs.mapInArrow(_spell(spark.sparkContext.broadcast(_bits(place, bits))),
                                       "h long, lang string, word string, n long"), "phrases-words")
    words = read.filter("h is not null").select("h", "lang", "word").dropDuplicates(["h"])
    spelled = [materialize(whole.filter("k = 1").select("h", "n").join(words, "h").select(
        "h", "lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "n"), "phrases-spelled")]
    for k in range(2, longest + 1):
        head = spelled[-1].select(F.col("h").alias("head"), "lang", F.col("phrase").alias("front"))
        last = spelled[0].select(F.col("h").alias("last"), F.col("phrase").alias("word"))
        spelled.append(materialize(whole.filter(F.col("k") == k).select("h", "head", "last", "n").join(head, "head").join(last, "last").select(
            "h", "lang", F.lit(k).alias("k"), F.concat_ws(" ", "front", "word").alias("phrase"), "n"), "phrases-spelled"))
    out = read.filter("h is null").groupBy("lang").agg(F.sum("n").alias("n")).select(
        "lang", F.lit(0).alias("k"), F.lit("").alias("phrase"), "n")
    for x in spelled:
        out = out.unionByName(x.drop("h"))
    return out


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, longest: int = MAX_WORDS,
                 shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``."""
    counts = materialize(frequent_phrases(docs, min_count, longest, shards, bits), "phrases-counts")
    phrase = counts.filter("k > 0").select("lang", "phrase", F.col("n").alias("a"))
    total = counts.filter("k = 0").select("lang", F.col("n"))
    some = counts.filter("k > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cut = some.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    part = lambda name, n: phrase.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    low = cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    # the largest count of a longer candidate around a phrase
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    around = (some.filter(F.size("w") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("around")))
    kept = low.join(around, ["lang", "phrase"], "left").filter("around is null or 100 * around < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


_CUTS = "[.,;:!?\\n\\x0B\\f\\r]"
_ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CUTS}') AS ps
  FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(ps) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM p),
u AS (SELECT lang, w, len(w) AS m FROM w WHERE len(w) > 0),
i AS (SELECT lang, w, k, unnest(range(1, m - k + 2)) AS i FROM u, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE m >= k),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM i),
c AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(m) AS n FROM u GROUP BY lang),
b AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE k > 1),
s AS (SELECT b.lang, b.phrase, b.k AS m, j.j, b.a, l.a AS l, r.a AS r, n.n,
             (1000::HUGEINT * b.a * n.n) // (l.a::HUGEINT * r.a) AS score
      FROM b JOIN range(1, 5) j(j) ON j.j < b.k JOIN n ON n.lang = b.lang
      JOIN c l ON l.lang = b.lang AND l.phrase = array_to_string(list_slice(b.w, 1, j.j), ' ')
      JOIN c r ON r.lang = b.lang AND r.phrase = array_to_string(list_slice(b.w, j.j + 1, b.k), ' ')),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
z AS (SELECT t.* FROM t WHERE NOT EXISTS (
        SELECT 1 FROM c o WHERE o.lang = t.lang AND o.k > t.m AND o.a >= t.a
          AND contains(' ' || o.phrase || ' ', ' ' || t.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM z QUALIFY rank <= 2000
"""


@query("op13_phrase_counts", sql=_ORACLE)
def op13(spark, sf_dir: str) -> DataFrame:
    """Contract: phrases of 2 to 5 words found 100 times, 2000 a language."""
    return collocations(table(spark, sf_dir, "documents"))
