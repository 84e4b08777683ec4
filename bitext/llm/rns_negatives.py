"""Hard negatives by exact inner products (operator 11).

Vectors become integers, floor(SCALE * x).  Their inner products are computed
as matrix products in a residue number system: for each of a few small primes
the components modulo that prime are multiplied in float32, over so few
dimensions at a time that every partial sum is an exact float32 integer, and
the signed score is put together from the residues (Garner's form of the
Chinese remainder theorem).  As many primes are taken as the block's largest
possible score needs.

Anchors are searched in blocks against all rows in blocks:

* rows are dealt to blocks of about ROWS rows by a number of their own (never
  by label or content, so hot labels and equal vectors lie spread), anchors to
  blocks of about ANCHORS;
* each anchor block is sent to each row block, one pair of blocks a record; a
  task holds one pair at a time and works it in slices;
* from a pair of blocks come each anchor's best rows only, and a window over
  the anchor's few rows picks the final ones.

The first pass finds each anchor's positives (best rows of its label), the
second its negatives: rows of another label whose score lies in a band below
the positive's.

Cases: rows with a null label, a null vector or a null or non-finite component
take no part.  A shorter vector counts as filled with zeros, an empty one as
zeros.  Repeated rows are rows of their own (an anchor's copy may be its
positive).  Rows with a null vec_id are no anchors and come after all others
on ties.  Scores beyond 64 bits count as the nearest 64-bit number.  Other
columns are ignored.  An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitext.session import materialize

from .registry import query, table

SCALE = 256
ROWS, ANCHORS = 16_384, 1_024
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is between LOW and HIGH percent of the positive's.
LOW, HIGH = 80, 100
#: Rows of a block that are multiplied at a time.
SLICE = 2_048
_TOP, _LEAST = 2**63 - 1, -(2**63)


def primes(product: int, start: int = 251) -> list[int]:
    """Primes from ``start`` downwards (and then upwards) whose product exceeds ``product``."""
    out, total = [], 1
    for p in [*range(start, 2, -1), *range(start + 1, 4096)]:
        if total > product:
            break
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            out.append(p)
            total *= p
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Integers held as float64 -> least absolute residues modulo p as float32."""
    r = np.fmod(x, p)
    half = p // 2
    r[r > half] -= p
    r[r < -half] += p
    return r.astype(np.float32)


def products_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, 0 to p - 1, from residues: float32 products over so
    few dimensions that no partial sum leaves the exact integers below 2**24."""
    most = max(1, (1 << 24) // max(1, (p // 2) ** 2) - 1)
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], most):
        out += (a[:, at: at + most] @ b[:, at: at + most].T).astype(np.int64)
    return out % p


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows held as float64, clipped to 64 bits."""
    dim = max(a.shape[1], b.shape[1], 1)
    bound = dim * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    ps = primes(4 * bound + 4)  # so the last digit shows the sign
    kind = np.int64 if bound < 2**50 else object
    value, weight, digits = np.zeros((len(a), len(b)), kind), 1, []
    for i, p in enumerate(ps):
        # next mixed-radix digit: (residue - value so far) / product so far, modulo p
        have, w = np.zeros((len(a), len(b)), np.int64), 1
        for q, d in zip(ps[:i], digits):
            have += d * (w % p)
            w *= q
        digit = (products_mod(residues(a, p), residues(b, p), p) - have) * pow(w % p, -1, p) % p
        digits.append(digit)
        if i + 1 == len(ps):  # the last digit carries the sign
            digit = np.where(2 * digit > p, digit - p, digit)
        value += digit.astype(kind) * weight
        weight *= p
    if kind is object:
        value = np.clip(value, _LEAST, _TOP).astype(np.int64)
    return value


def _matrix(col: pa.Array, scale: int) -> np.ndarray:
    """List column without nulls -> floor(scale * x), rows filled with zeros;
    float32 if that holds the numbers exactly."""
    off, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(off)
    out = np.zeros((len(size), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(off[0], off[-1]) - np.repeat(off[:-1], size)] = flat[off[0]: off[-1]]
    out = np.clip(np.floor(scale * out), -1e300, 1e300)
    return out.astype(np.float32) if np.abs(out).max(initial=0) < 1 << 24 else out


def _packed(column: str, scale: int):
    """Rows of a block -> one record with their columns as bytes."""
    def run(key, t):
        m = _matrix(t["embedding"].combine_chunks(), scale)
        found = {column: key[0].as_py(), "n": len(t), "dim": m.shape[1], "rows": t["row"].to_numpy().tobytes(),
                 "ids": t["vec_id"].fill_null(_TOP).to_numpy().tobytes(), "labels": t["label"].to_numpy().tobytes(),
                 "vectors": m.tobytes()}
        if "bands" in t.column_names:
            found["bands"] = np.array(t["bands"].to_pylist(), np.int64).tobytes()
        return pa.Table.from_pydict({c: [v] for c, v in found.items()})
    return run


_BLOCK = "n long, dim long, rows binary, ids binary, labels binary, vectors binary"


class _Block:
    def __init__(self, get, bands: int = 0):
        n, dim, vectors = get("n"), get("dim"), get("vectors")
        self.rows, self.ids, self.labels = (np.frombuffer(get(c), np.int64) for c in ("rows", "ids", "labels"))
        self.m = np.frombuffer(vectors, np.float32 if len(vectors) == 4 * n * dim else np.float64).reshape(n, dim).astype(float)
        if bands:
            self.bands = np.frombuffer(get("bands"), np.int64).reshape(n, bands)

    def widened(self, dim: int) -> np.ndarray:
        return self.m if self.m.shape[1] == dim else np.pad(self.m, ((0, 0), (0, dim - self.m.shape[1])))


def _tiles(bands: int, pick, schema: pa.Schema):
    """Pairs of blocks -> what ``pick`` finds in each slice of rows."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, anchor = (_Block(lambda c: batch.column(p + c)[i].as_py(), b)
                               for p, b in (("", 0), ("a_", bands)))
                dim = max(row.m.shape[1], anchor.m.shape[1])
                a = anchor.widened(dim)
                for lo in range(0, len(row.ids), SLICE):
                    part = slice(lo, lo + SLICE)
                    s = scores(row.widened(dim)[part], a)
                    same = row.labels[part, None] == anchor.labels[None, :]
                    found = pick(s, same, row.rows[part], row.ids[part], anchor)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)
    return run


def _first(key: np.ndarray, k: int) -> np.ndarray:
    """Of a sorted key, the places of each value's first k entries."""
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    at = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    return np.flatnonzero(at < k)


def _pick_positives(k: int):
    def pick(s, same, rows, ids, anchor):
        same &= rows[:, None] != anchor.rows[None, :]
        s = np.where(same, s, _LEAST)
        if len(s) > k:  # only rows that reach the k-th best score
            same &= s >= np.partition(s, len(s) - k, axis=0)[len(s) - k]
        i, a = np.nonzero(same)
        order = np.lexsort((ids[i], ~s[i, a], a))  # ~: descending
        order = order[_first(a[order], k)]
        i, a = i[order], a[order]
        return anchor.rows[a], anchor.ids[a], s[i, a], ids[i]
    return pick


def _pick_negatives(k: int):
    def pick(s, same, rows, ids, anchor):
        # bands: for each positive its place, lowest and highest score
        low, high, place = anchor.bands[:, 1::3], anchor.bands[:, 2::3], anchor.bands[:, 0::3]
        i, a = np.nonzero(~same & (s >= low.min(axis=1)) & (s <= high.max(axis=1)))
        v = s[i, a]
        order = np.lexsort((ids[i], ~v, a))
        i, a, v = i[order], a[order], v[order]
        out = []
        for j in range(low.shape[1]):
            at = np.flatnonzero((place[a, j] > 0) & (v >= low[a, j]) & (v <= high[a, j]))
            at = at[_first(a[at], k)]
            out.append((anchor.rows[a[at]], place[a[at], j], v[at], ids[i[at]]))
        return tuple(np.concatenate(x) for x in zip(*out))
    return pick


_LONG = pa.int64()


def _blocks(df: DataFrame, column: str, n: int, scale: int, more: str = "") -> DataFrame:
    key = F.pmod(F.xxhash64("row"), F.lit(n)).alias(column)
    return df.groupBy(key).applyInArrow(_packed(column, scale), f"{column} long, {_BLOCK}{more}")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE, rows: int = ROWS,
                   anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)
    from vectors (vec_id, embedding, label).  Anchors are rows whose vec_id
    ``every`` divides; ``low`` and ``high`` are percent of the positive's score."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    data = materialize(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
        .withColumn("row", F.monotonically_increasing_id()), "rns-rows")
    some = data.filter(F.col("vec_id") % every == 0)
    total, asked = data.count(), some.count()
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_rows, n_anchors = max(spread, -(-total // rows)), max(1, -(-asked // anchors))
    blocks = materialize(_blocks(data, "block", n_rows, scale), "rns-blocks")

    def pairs(block_of: DataFrame) -> DataFrame:
        """Each anchor block beside each row block.  Spark reckons with one copy
        of the anchors here, so that it may never choose to broadcast all of them."""
        names = [c for c in block_of.columns if c != "ablock"]
        sent = block_of.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))).alias("block"),
                               *(F.col(c).alias(f"a_{c}") for c in names))
        return blocks.join(sent.hint("merge"), "block")

    found = pairs(_blocks(some, "ablock", n_anchors, scale)).mapInArrow(
        _tiles(0, _pick_positives(positives), pa.schema([(c, _LONG) for c in ("row", "anchor_id", "score", "id")])),
        "row long, anchor_id long, score long, id long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "id")
    chosen = materialize(found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives), "rns-positives")
    # bands in whole numbers: low % rounded up, high % rounded down; hundreds
    # and rest apart, so that no product leaves 64 bits
    def percent(p: int, up: int):
        return F.expr(f"(score div 100 - if(score % 100 < 0, 1L, 0L)) * {p} + (pmod(score, 100) * {p} + {up}) div 100")
    bands = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        F.col("place").cast("long").alias("p"), percent(low, 99).alias("lo"), percent(high, 0).alias("hi")))).alias("b"))
    none = F.array(F.lit(0).cast("long"), F.lit(_TOP), F.lit(_LEAST))  # an empty band
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(
        F.transform(F.slice("b", i + 1, F.lit(1)), lambda x: F.array(x["p"], x["lo"], x["hi"])).getItem(0), none)))
    asked_for = some.join(bands, "row").withColumn("bands", flat).drop("b")
    hits = pairs(_blocks(asked_for, "ablock", n_anchors, scale, ", bands binary")).mapInArrow(
        _tiles(3 * positives, _pick_negatives(negatives), pa.schema([(c, _LONG) for c in ("row", "place", "score", "id")])),
        "row long, place long, score long, id long")
    order = Window.partitionBy("row", "place").orderBy(F.col("score").desc(), "id")
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    known = lambda c: F.when(F.col(c) != _TOP, F.col(c))  # noqa: E731  a null vec_id travels as the largest long
    return hits.join(chosen.select("row", F.col("place").cast("long").alias("place"), "anchor_id",
                                   known("id").alias("positive_id"), F.col("score").alias("positive_score")),
                     ["row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


_ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_inner_product(a.c, b.c)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT r, anchor_id, id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS place
  FROM s WHERE same QUALIFY place <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.r = s.r WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op11_rns_negatives", sql=_ORACLE)
def op11(spark, sf_dir: str) -> DataFrame:
    """Contract: rows whose vec_id 7 divides change label first; anchors are
    rows whose vec_id 100 divides."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    return hard_negatives(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))
