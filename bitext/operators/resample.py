"""Intervals of mean scores by the Poisson bootstrap.

A row's weight in replicate b is a Poisson(1) number drawn from a hash of its
key and b, so all replicates are one pass over the scored rows, any engine
draws the same weights, and rows of one key get the same weight for every
system: differences are paired.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 200


def poisson_cuts(bits: int = 32) -> list[int]:
    """Numbers c_k: a uniform number under 2^bits gives the Poisson(1) value
    'how many c_k it reaches'; ends where the next would be 2^bits."""
    out, p, total = [], math.exp(-1), 0.0
    for k in range(1, 40):
        total += p
        cut = math.floor(total * 2 ** bits)
        if cut >= 2 ** bits - 1:
            break
        out.append(cut)
        p /= k
    return out


def poisson_weight(key: Column, replicate: Column) -> Column:
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string"))), 1, 8), 16, 10).cast("long")
    return sum(((draw >= F.lit(c)).cast("int") for c in poisson_cuts()), F.lit(0))


def score_intervals(scored: DataFrame, key: str, scores: Sequence[str], replicates: int = REPLICATES,
                    level: float = 0.95) -> DataFrame:
    """One row per score column: ``system``, ``mean``, ``low``, ``median`` and
    ``high`` of the replicates' means (percentiles by interpolation), and
    ``p_first``: the share of replicates in which its mean is not under that of
    the first column (1 for the first itself).

    Null scores (and NaN) are left out of a mean.  The replicates are rows of a
    partial aggregation (one a replicate and task), never of a shuffle of
    scores; the final table has ``replicates`` rows a system.
    """
    clean = [F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")).alias(f"s{i}") for i, s in enumerate(scores)]
    rows = scored.select(F.col(key).alias("k"), *clean)
    drawn = (rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
             .withColumn("w", F.when(F.col("b") == 0, 1).otherwise(poisson_weight(F.col("k"), F.col("b")))))
    sums = drawn.groupBy("b").agg(*[(F.sum(F.col("w") * F.col(f"s{i}")) / F.sum(F.when(F.col(f"s{i}").isNotNull(), F.col("w"))))
                                    .alias(f"m{i}") for i in range(len(scores))])
    tail = (1 - level) / 2
    tall = sums.select("b", F.col("m0").alias("first"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(s).alias("system"), F.col(f"m{i}").alias("m")) for i, s in enumerate(scores)])))
    drawn = F.col("b") > 0
    at = lambda p: F.percentile(F.when(drawn, F.col("m")), p)
    return tall.groupBy("i", "system").agg(
        F.max(F.when(~drawn, F.col("m"))).alias("mean"), at(tail).alias("low"), at(0.5).alias("median"),
        at(1 - tail).alias("high"),
        F.avg(F.when(drawn, (F.col("m") >= F.col("first")).cast("double"))).alias("p_first")).drop("i")
