"""Mergeable sketches of scores: quantiles and acceptance thresholds of data
that is not read again.

A sketch is a table of at most ``bins`` + 1 rows a group: how many scores fall
into each of equal steps from ``lo`` to ``hi``.  Sketches of days, shards or
runs merge by adding counts, in any order, to the sketch of all rows together.
A quantile is off by at most half a step (2 / 4,096 / 2 for similarities); the
counts above a step's edge are exact.  Scores beyond the ends fall in the end
steps; null and NaN have a step of their own (-1), which no threshold accepts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS, LO, HI = 4096, -1.0, 1.0


def score_sketch(df: DataFrame, group_cols: Sequence[str], score: str = "similarity", bins: int = BINS,
                 lo: float = LO, hi: float = HI) -> DataFrame:
    """``(*group_cols, bin, n)``, one aggregation with partial counts.  A
    power of two of bins over a range of one keeps every edge exact."""
    x = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    step = F.floor((x - F.lit(lo)) * F.lit(bins / (hi - lo)))
    inside = F.greatest(F.lit(0), F.least(F.lit(bins - 1), step)).cast("int")
    return (df.select(*group_cols, F.when(x.isNull(), F.lit(-1)).otherwise(inside).alias("bin"))
              .groupBy(*group_cols, "bin").agg(F.count(F.lit(1)).alias("n")))


def merge_sketches(sketches: Iterable[DataFrame], group_cols: Sequence[str]) -> DataFrame:
    """The sketch of all rows; with fewer group columns, of the wider groups."""
    first, *rest = list(sketches)
    cols = [*group_cols, "bin", "n"]
    both = first.select(*cols)
    for s in rest:
        both = both.unionByName(s.select(*cols))
    return both.groupBy(*group_cols, "bin").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, group_cols: Sequence[str], percents: Iterable[int] = (10, 50, 90),
                     bins: int = BINS, lo: float = LO, hi: float = HI) -> DataFrame:
    """``(*group_cols, n, n_null, p10, ...)``: the middle of the step that holds
    the ceil(n p / 100)-th smallest score.  Windows run over a sketch's rows."""
    g, width = list(group_cols), (hi - lo) / bins
    scored = F.when(F.col("bin") >= 0, F.col("n")).otherwise(0)
    below = Window.partitionBy(*g).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = sketch.withColumns({"_cum": F.sum(scored).over(below), "_all": F.sum(scored).over(Window.partitionBy(*g))})
    middle = F.lit(lo) + (F.col("bin") + F.lit(0.5)) * F.lit(width)
    found = [F.min(F.when((F.col("bin") >= 0) & (F.col("_cum") * 100 >= F.col("_all") * int(p)), middle)).alias(f"p{p}")
             for p in percents]
    return rows.groupBy(*g).agg(F.sum(scored).alias("n"), F.sum(F.when(F.col("bin") < 0, F.col("n")).otherwise(0)).alias("n_null"),
                                *found)


def sketch_threshold(sketch: DataFrame, group_cols: Sequence[str], accept: int, bins: int = BINS, lo: float = LO,
                     hi: float = HI) -> DataFrame:
    """``(*group_cols, threshold, accepted)``: the greatest edge that at least
    ``accept`` scores reach, and how many do; the lowest edge where a group has
    fewer scores.  Ties above ``accept`` are all accepted."""
    g, width = list(group_cols), (hi - lo) / bins
    above = Window.partitionBy(*g).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = sketch.where("bin >= 0").withColumn("_up", F.sum("n").over(above))
    reached = F.when(F.col("_up") >= accept, F.struct("bin", "_up"))
    best = rows.groupBy(*g).agg(F.max(reached).alias("_b"), F.max("_up").alias("_all"))
    return best.select(*g, F.coalesce(F.lit(lo) + F.col("_b.bin") * F.lit(width), F.lit(lo)).alias("threshold"),
                       F.coalesce("_b._up", "_all").alias("accepted"))
