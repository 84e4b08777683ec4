"""MinHash near-duplicate groups with odd sketches (operator 9).

Each text becomes its set of distinct k-word shingles.  ``bands * rows``
MinHash values are folded into a parity bitmap (an odd sketch): every (index,
minimum) flips one bit, so the popcount of two bitmaps' XOR estimates how many
minima differ, which is most precise at high similarity.  Bands of minima
propose candidates, the bitmaps thin them, and full sets decide.

Work stays linear where copies pile up: equal sets collapse to one class
before banding; a bucket's members are first compared with the bucket's leader
only; members that this leaves in other components (seekers) are then compared
with the rest of their buckets, in tiles of two blocks: seekers with seekers
and seekers with the main component.  That is quadratic in a bucket's seekers,
but no task gets more than a tile.  For these, a second bitmap folds the whole
set: its XOR has at most as many bits as the sets differ in, so it drops a pair
only if the similarity is surely too low, and what it lets through is seldom
dropped later.  Only such pairs are written.  No bucket is capped.  A pair with the wanted similarity s shares
no band with probability (1 - s**rows)**bands: 3e-6 at s = 0.8 as configured.

Cases: null or wordless texts have an empty set and link with nothing; rows
that share a doc_id are one document; a null doc_id is not linked (its
component is null, it is kept).  Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.session import materialize

from . import textkit as tk
from .components import components
from .registry import query, table

BANDS, ROWS = 32, 5
SKETCH_BITS = 512
#: Bits of the parity bitmap over a whole set.
WHOLE_BITS = 2048
#: How far below the wanted similarity the bitmap's estimate may lie.
SKETCH_SLACK = 0.2
#: Rows of a block; a task compares a block with itself or with another.
BLOCK_ROWS = 20_000
#: A tile's number is its lower block times TILE plus its higher block.
TILE = 1 << 31

_SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, odd array<long>"


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = tk.mix64(np.arange(1, 2 * n + 1, dtype=np.uint64))
    low = (seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return low[:n] | np.uint32(1), low[n:]


def _minima(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (sets >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(best, (x[i: i + 2048, None] * a + b).min(axis=0), out=best)
    return best


def _set_hash(s: np.ndarray) -> tuple[np.int64, np.int64]:
    return (tk.mix64(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64),
            np.bitwise_xor.reduce(tk.mix64(s ^ np.uint64(0x5DEECE66D))).view(np.int64))


def _sets(col, words: int):
    """The shingle set of each row of an Arrow string column."""
    data, off = tk.flat_utf8(col)
    for lo, hi in tk.slices(off):
        part, o = tk.LOWER[data[off[lo]: off[hi]]], off[lo: hi + 1] - off[lo]
        starts, ends, at = tk.pieces(part, o, tk.SPACE)
        h = tk.piece_hashes(part, starts, ends)
        for i in range(hi - lo):
            yield tk.shingle_set(h[at[i]: at[i + 1]], words)


def _signer(words: int, bands: int, rows: int, bits: int):
    def run(batches):
        k = bands * rows
        a, b = _coefficients(k)
        index = np.arange(k, dtype=np.uint64) << np.uint64(32)
        band = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            sizes, h1, h2, has, keys, odd = [], [], [], [0], [], []
            for s in _sets(batch.column(1), words):
                sizes.append(len(s))
                if not len(s):
                    h1.append(0)
                    h2.append(0)
                    has.append(has[-1])
                    continue
                x, y = _set_hash(s)
                h1.append(x)
                h2.append(y)
                has.append(has[-1] + 1)
                m = _minima(s, a, b)
                flips = tk.mix64(index | m) % np.uint64(bits)
                odd.append(_parity(flips, bits).view(np.int64))
                key = band
                for r in range(rows):
                    key = tk.mix64(key + np.uint64(0x9E3779B97F4A7C15)) ^ m[r::rows]
                keys.append(tk.mix64(key).view(np.int64))
            has = np.array(has, np.int32)

            def lists(parts, width):
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(has * width, pa.int32()), pa.array(flat, pa.int64()))

            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 lists(keys, bands), lists(odd, bits // 64)],
                names=["doc_id", "n_shingles", "h1", "h2", "keys", "odd"])
    return run


def _parity(positions: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits(np.bincount(positions.astype(np.int64), minlength=bits) & 1 > 0)


def _set_rows(words: int):
    """(node, text) -> (node, its sorted set, the set's parity bitmap), where
    the text has that node's set."""
    def run(batches):
        for batch in batches:
            node, out, whole = batch.column(0).to_pylist(), [], []
            for n, s in zip(node, _sets(batch.column(1), words)):
                ok = len(s) and _set_hash(s)[0] == n
                out.append(s.tobytes() if ok else None)
                whole.append(_parity(tk.mix64(s) % np.uint64(WHOLE_BITS), WHOLE_BITS).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(whole, pa.binary())],
                                             names=["node", "set", "whole"])
    return run


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _rest(most_bits: int, num: int, den: int):
    """Pairs across components of each (key, tile) that the bitmaps allow.
    Only rows outside the bucket's main component search; a pair is written in
    the first band that it shares; pairs with the leader are known already."""
    def pairs(key, tile, rows):
        node, comp = rows["node"].to_numpy(), rows["component"].to_numpy()
        main, lead = (rows[c].to_numpy(zero_copy_only=False) for c in ("main", "lead"))
        size, block = rows["n_shingles"].to_numpy(), rows["block"].to_numpy()
        flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
        odd = flat("odd").view(np.uint64).reshape(len(node), -1)
        keys = flat("keys").reshape(len(node), -1)
        whole = np.frombuffer(b"".join(rows["whole"].to_pylist()), np.uint64).reshape(len(node), -1)
        low, high = divmod(tile, TILE)
        seekers = np.flatnonzero(~main & (block == low))
        others = np.flatnonzero(~lead & (main | (block == high)))
        for at in range(0, len(seekers), 32):
            some = seekers[at: at + 32]
            ok = np.bitwise_count(odd[some][:, None, :] ^ odd[others][None, :, :]).sum(-1) <= most_bits
            ok &= comp[some][:, None] != comp[others][None, :]
            x, y = size[some][:, None], size[others][None, :]
            ok &= den * np.minimum(x, y) >= num * np.maximum(x, y)
            if low == high:  # each pair of seekers once
                ok &= main[others][None, :] | (node[some][:, None] < node[others][None, :])
            i, j = np.nonzero(ok)
            i, j = some[i], others[j]
            differ = np.zeros(len(i), np.int64)
            for lo in range(0, len(i), 65536):
                hi = lo + 65536
                differ[lo:hi] = np.bitwise_count(whole[i[lo:hi]] ^ whole[j[lo:hi]]).sum(-1)
            ok = (den + num) * differ <= (den - num) * (size[i] + size[j])
            i, j = i[ok], j[ok]
            same = keys[i] == keys[j]
            first = keys[i, same.argmax(axis=1)] == key if len(i) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(node[i[first]]), pa.array(node[j[first]])], names=["a", "b"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            k, s = t["key"].to_numpy(), t["tile"].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(k)]):
                if lo == hi:
                    continue
                if at is not None and at != (k[lo], s[lo]):
                    yield from pairs(*at, pa.concat_tables(held))
                    held = []
                at = (k[lo], s[lo])
                held.append(t.slice(lo, hi - lo))
        if held:
            yield from pairs(*at, pa.concat_tables(held))
    return run


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bands: int = BANDS,
                    rows: int = ROWS, bits: int = SKETCH_BITS, slack: float = SKETCH_SLACK,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``num/den`` or
    more of their ``words``-word shingle sets.

    Returns per row: doc_id, n_shingles, component_id (the smallest doc_id of
    the group), kept (doc_id is component_id)."""
    spark = docs.sparkSession
    k, least = bands * rows, num / den - slack
    most_bits = int(bits / 2 * (1 - math.exp(-4 * k * (1 - least) / bits)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    signed = materialize(texts.mapInArrow(_signer(words, bands, rows, bits), _SIGNED), "near-signed")
    classes = materialize(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles")
        .agg(F.min("doc_id").alias("first_doc"), F.first("keys").alias("keys"), F.first("odd").alias("odd"))
        .withColumn("node", F.col("h1")), "near-classes")

    member = classes.select("node", "first_doc", F.explode("keys").alias("key"))
    lead = (member.groupBy("key").agg(F.min(F.struct("first_doc", "node")).alias("lead"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1").select("key", F.col("lead.node").alias("lead")))
    member = materialize(member.join(lead, "key").select("key", "node", "first_doc", "lead"), "near-members")

    sketch = classes.select("node", "n_shingles", "odd")
    star = member.filter("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    star = (star.join(sketch.toDF("a", "na", "oa"), "a").join(sketch.toDF("b", "nb", "ob"), "b")
            .filter(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
            .filter(f"aggregate(zip_with(oa, ob, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {most_bits}")
            .select("a", "b"))

    active = member.select("node", "first_doc").distinct()
    sets = materialize(
        texts.join(active, F.col("doc_id") == F.col("first_doc")).select("node", "text")
        .mapInArrow(_set_rows(words), "node long, set binary, whole binary").filter("set is not null"), "near-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb"))
        return materialize(both.mapInArrow(_confirm(num, den), "a long, b long").distinct(), "near-links")

    # rows that share a doc_id are one document: their classes are linked
    own = signed.filter("n_shingles > 0 and doc_id is not null")
    several = own.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).filter("a != z").select("doc_id", "a")
    same = own.join(several, "doc_id").select("a", F.col("h1").alias("b")).distinct()
    links = materialize(confirmed(star).unionByName(same), "near-all-links")
    labels = components(links)

    joined = member.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leads = joined.filter("node = lead").select("key", F.col("component").alias("main_component"))
    seeks = F.col("component") != F.col("main_component")
    mixed = (joined.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).join(leads, "key")
             .groupBy("key", "main_component").agg(F.sum("n").alias("n"), F.sum(F.when(seeks, F.col("n")).otherwise(0)).alias("seekers"))
             .filter("seekers > 0").select(
                 "key", "main_component", F.ceil(F.col("seekers") / block_rows).alias("sb"),
                 F.when(F.col("n") <= block_rows, 0).otherwise(F.ceil((F.col("n") - F.col("seekers")) / block_rows)).alias("mb")))
    # Seekers have the blocks 0 to sb - 1, the main component the next mb, or the one block of a small bucket.
    deal = F.hash("node").cast("long")
    rest = (joined.join(mixed, "key").withColumn("main", ~seeks)
            .withColumn("block", F.when(~F.col("main"), F.pmod(deal, F.col("sb"))).when(F.col("mb") == 0, F.lit(0))
                        .otherwise(F.col("sb") + F.pmod(deal, F.greatest("mb", F.lit(1)))).cast("long"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("main"), F.col("sb") - 1)
                                                      .otherwise(F.col("sb") + F.col("mb") - 1).cast("long"))))
            .withColumn("tile", F.least("block", "other") * F.lit(TILE) + F.greatest("block", "other"))
            .join(classes.select("node", "n_shingles", "odd", "keys"), "node").join(sets.select("node", "whole"), "node")
            .select("key", "tile", "block", "node", "component", "main", (F.col("node") == F.col("lead")).alias("lead"),
                    "n_shingles", "odd", "keys", "whole")
            .repartition("key", "tile").sortWithinPartitions("key", "tile"))
    more = confirmed(rest.mapInArrow(_rest(most_bits, num, den), "a long, b long"))
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    named = classes.select("h1", "h2", "n_shingles", "node", "first_doc").join(labels, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = named.join(first, "component").select("h1", "h2", "n_shingles", "component_id")
    return (signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


@query("op9_odd_sketch")
def op9(spark, sf_dir: str) -> DataFrame:
    """Contract: sets of 2-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
