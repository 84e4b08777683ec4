"""Mixing sources to target weights (operator 10), DataFrame functions only.

A source's target is its weighted share of ``share`` times all words, at most
``most`` times its own words; what exceeds that goes to the others by weight
until none is above.  This is water filling: with sources ordered by words per
weight, those whose cap lies under the common level form a prefix, found with
running sums over the table of sources.

A source is read in whole epochs first.  The rest of its target is a weighted
sample without replacement: document keys -ln(u)/q (Efraimidis-Spirakis, u
from a hash of doc_id, q the quality weight) are sorted, and documents are
taken while the middle of their word range lies before the budget, so a
source misses its target by half a document at most.  Prefix sums are made in
two levels, over key ranges and within one, so no task holds a whole source.

Cases: a null or wordless text has size 0; a null source is a source, ordered
last; a source without words has target 0; rows that share a doc_id have equal
keys and are ordered by size; a weight that is null or not positive counts as
the smallest double; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitext.session import materialize

from .registry import query, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Key ranges per source for the two-level prefix sums.
RANGES = 4096

WORDS = r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0)"
#: Documents with fewer symbol characters per word come earlier.
QUALITY = ("1D / (1D + 4D * coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) / greatest(_size, 1))")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source (key, source): source_size and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", "key")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"))
    s = s.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = (s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("all_weight", F.sum("weight").over(everything))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("full", F.col("ratio") * (F.col("all_weight") - F.col("weight_before"))
                     <= F.col("budget") - F.col("cap_before")))
    s = (s.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything))
         .withColumn("weight_open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)))
    target = F.when(F.col("full"), F.col("cap")).otherwise(
        F.col("weight") * (F.col("budget") - F.col("cap_full")) / F.col("weight_open"))
    return s.select("key", "source_size", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, quality: str = QUALITY, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: int = 0, ranges: int = RANGES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words)
    and copies (how often the mix repeats the row), and the columns ``keep``.  ``quality`` is SQL
    over text and _size."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                                  .cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    least = 1e-300
    sized = materialize(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), *keep)
        .withColumn("_size", F.expr(WORDS).cast("long"))
        .withColumn("q", F.greatest(F.coalesce(F.expr(quality), F.lit(least)), F.lit(least)))
        .select("doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), "_size",
                (-F.ln(u) / F.col("q")).alias("order"), *keep), "mix-sizes")
    targets = source_targets(sized, weights, share, most)
    # complete epochs, and the budget of the fractional one
    targets = materialize(
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
            F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) + 1e-9)).otherwise(0))
        .withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))),
        "mix-targets")

    ranged = sized.withColumn("range", F.floor((1 - F.exp(-F.col("order"))) * ranges).cast("int"))
    totals = ranged.groupBy("key", "range").agg(F.sum("_size").alias("total"))
    up_to = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (totals.withColumn("start", F.coalesce(F.sum("total").over(up_to), F.lit(0)))
              .join(targets, "key").select("key", "range", "start", "source_size", "target", "epochs", "rest"))
    within = (Window.partitionBy("key", "range").orderBy("order", "doc_id", "_size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (ranged.join(starts, ["key", "range"])
            .withColumn("end", F.col("start") + F.sum("_size").over(within))
            .withColumn("more", (2 * F.col("end") - F.col("_size") < 2 * F.col("rest")).cast("int"))
            .withColumn("copies", (F.col("epochs") + F.col("more")).cast("int"))
            .select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                    (F.col("copies") * F.col("_size")).alias("taken"), "copies", *keep))


_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS sym
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / (1.0::DOUBLE / (1.0::DOUBLE + 4.0::DOUBLE * sym / greatest(size, 1))) AS ord
  FROM d),
s AS (
  SELECT source, sum(size)::DOUBLE AS total, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, sum(total) OVER () * 1.5::DOUBLE AS budget,
         cap / w * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) <= sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0) AS full_
  FROM s WINDOW b AS (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, total, round(CASE WHEN full_ THEN cap ELSE w * (budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ())
                        / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END, 6) AS target
  FROM l),
e AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total + 1e-9) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.doc_id, k.size, e.total, e.target, e.epochs, e.target - e.epochs * e.total AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.ord, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, (epochs + (2 * upto - size < 2 * rest)::INT)::INT AS copies FROM p)
SELECT doc_id, size, total::BIGINT AS source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""


@query("op10_es_mixing", _SQL)
def op10(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
