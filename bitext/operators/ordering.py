"""Running aggregates and row numbers that never put a hot key (or the
whole table) in one task.

``sum(x) over (partition by k order by o rows unbounded preceding)`` sends
every row of key k to one task.  Here the table is range-partitioned on
(keys, order) instead, so a key that holds a third of the rows is cut into
many partitions.  Each partition computes its own running value per key; a
small table of per-(partition, key) block totals (at most one row per range
partition per key) gives each block the total of the blocks before it.  The
block assignment is written once (see ``running_by``) so that it cannot
differ between the two uses.
Supported: running ``sum`` (row numbers are running sums of 1) and running
``max``, inclusive or exclusive of the current row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "max": F.max}


def running_many(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                 specs: Sequence[tuple], num_partitions: int | None = None) -> DataFrame:
    """Several running aggregates in one pass.  ``specs`` = tuples
    ``(value, how, out, exclusive)`` with ``how`` in {'sum', 'max'};
    ``exclusive`` leaves the current row out (null when nothing precedes it,
    for ``max``; 0 for ``sum``)."""
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vals = {f"_v{i}": (F.col(v) if isinstance(v, str) else v) for i, (v, _, _, _) in enumerate(specs)}
    # The block id must be the same in every use below.  A range partitioner
    # samples its input, and a shuffled input has no fixed row order, so two
    # evaluations could draw different bounds: the rows are written once
    # with their block id (also a lineage cut).
    from ..session import materialize
    ranged = materialize(df.withColumns(vals)
                           .repartitionByRange(n, *[F.col(k) for k in keys], *order_cols)
                           .withColumn("_pid", F.spark_partition_id()), "running")
    w = Window.partitionBy("_pid", *keys).orderBy(*order_cols)
    local = ranged.withColumns({
        f"_l{i}": _AGG[how](f"_v{i}").over(
            w.rowsBetween(Window.unboundedPreceding, -1 if excl else 0))
        for i, (_, how, _, excl) in enumerate(specs)})
    blocks = ranged.groupBy("_pid", *keys).agg(*[_AGG[how](f"_v{i}").alias(f"_b{i}")
                                                 for i, (_, how, _, _) in enumerate(specs)])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_pid", *keys, *[_AGG[how](f"_b{i}").over(before).alias(f"_o{i}")
                                             for i, (_, how, _, _) in enumerate(specs)])
    # null-safe: rows with a null key are a key of their own
    right = offsets.withColumnsRenamed({c: f"_k_{c}" for c in ["_pid", *keys]})
    on = [local[c].eqNullSafe(right[f"_k_{c}"]) for c in ["_pid", *keys]]
    out = local.join(right, reduce(and_, on), "inner").drop(*[f"_k_{c}" for c in ["_pid", *keys]])
    res = {}
    for i, (_, how, name, _) in enumerate(specs):
        if how == "sum":
            res[name] = F.coalesce(F.col(f"_o{i}"), F.lit(0)) + F.coalesce(F.col(f"_l{i}"), F.lit(0))
        else:
            res[name] = F.greatest(F.col(f"_o{i}"), F.col(f"_l{i}"))  # greatest skips nulls
    drop = [c for i in range(len(specs)) for c in (f"_v{i}", f"_l{i}", f"_o{i}")] + ["_pid"]
    return out.withColumns(res).drop(*drop)


def running_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column | str,
               how: str = "sum", out: str = "running", exclusive: bool = False,
               num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = running ``how`` of ``value`` per ``keys`` in ``order``
    (a total order within a key)."""
    return running_many(df, keys, order, [(value, how, out, exclusive)], num_partitions)


def row_number_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                  out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """1-based ``row_number`` per ``keys`` following ``order`` (must be a total
    order within a key for a deterministic result)."""
    return running_by(df, keys, order, F.lit(1).cast("long"), "sum", out,
                      num_partitions=num_partitions).withColumn(out, F.col(out).cast("long"))
