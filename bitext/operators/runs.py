"""Run-log analytics: batches, progress, best checkpoint, early stop,
checkpoint retention, run names.

An evaluation log is ``(run, step, metric)`` (greater is better); a job log
is ``(job, ts, rows)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import run_name
from .ordering import row_number_by, running_by, running_many


def batch_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], batch_size: int,
                 out: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows per key, in ``order``:
    ``floor((row_number - 1) / batch_size)``, numbered without gathering a
    key in one task (``row_number_by``)."""
    numbered = row_number_by(df, keys, order, "_rn")
    return numbered.withColumn(out, F.floor((F.col("_rn") - 1) / batch_size).cast("long")).drop("_rn")


def running_progress(log: DataFrame, job: str, ts: str, rows: str | None = None,
                     order: str | None = None, total: str | None = None) -> DataFrame:
    """Per log row: ``done`` (rows finished so far in the job), ``elapsed_s``
    since the job's first row, ``rows_per_s`` (null at 0 s) and ``eta_s`` (null
    while nothing is done).  Records of a null job are a job of their own.

    ``rows`` (default 1 per record) is summed in (ts, order) order with the
    skew-safe ``running_by``; the job start and total are a ``groupBy``.
    """
    order_cols = [ts] + ([order] if order else [])
    r = F.col(rows) if rows else F.lit(1)
    base = log.withColumn("_r", r.cast("long"))
    firsts = base.groupBy(job).agg(F.min(ts).alias("_t0"), F.sum("_r").alias("_tot"))
    firsts = firsts.withColumnRenamed(job, "_job")
    out = running_by(base, [job], order_cols, "_r", "sum", "done")
    out = out.join(firsts, out[job].eqNullSafe(firsts["_job"]), "inner").drop("_job")
    secs = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / 1e6
    tot = F.col(total) if total else F.col("_tot")
    speed = F.when(F.col("elapsed_s") > 0, F.col("done") / F.col("elapsed_s"))
    return (out.withColumn("elapsed_s", secs)
               .withColumn("rows_per_s", speed)
               .withColumn("eta_s", F.when(F.col("rows_per_s") > 0, (tot - F.col("done")) / F.col("rows_per_s")))
               .drop("_r", "_t0", "_tot"))


def best_checkpoint(log: DataFrame, run: str, step: str, metric: str) -> DataFrame:
    """``(run, best_step, best_metric)``: highest metric, tie → earlier step.
    One ``groupBy`` with ``max_by`` over (metric, -step): partial aggregation."""
    key = F.struct(F.col(metric).alias("m"), (-F.col(step)).alias("s"))
    return log.where(F.col(metric).isNotNull() & ~F.isnan(metric)).groupBy(run).agg(
        F.max_by(F.col(step), key).alias("best_step"), F.max(metric).alias("best_metric"))


def early_stop(log: DataFrame, run: str, step: str, metric: str, patience: int) -> DataFrame:
    """``(run, stop_step, best_step, best_metric, n_evals)``: the step at which
    ``patience`` evaluations in a row have not strictly beaten the best so
    far (null when the run never stops).  Every run of the log is there; one
    without any metric has no best, and stops after ``patience`` evaluations.

    Improvement flag from the running max of the previous rows; the running
    count of improvements numbers the stretches; inside a stretch the stale
    count is the offset from its first row.  All three are skew-safe running
    aggregates (``running_by``), so a run with a huge log is spread over
    many tasks.
    """
    # NaN is no improvement, as "greater than" is false with it; Spark would
    # order it highest, so it is read as missing
    log = log.select(run, step, F.nanvl(F.col(metric).cast("double"), F.lit(None)).alias(metric))
    base = log
    # pass 1: row number and best of the previous rows
    p1 = running_many(base, [run], [step], [(F.lit(1).cast("long"), "sum", "_rn", False),
                                            (metric, "max", "_prev", True)])
    imp = F.col(metric).isNotNull() & (F.col("_prev").isNull() | (F.col(metric) > F.col("_prev")))
    # pass 2: row number of the latest improvement; stale = rows since it
    p2 = running_many(p1.withColumn("_imp_rn", F.when(imp, F.col("_rn"))), [run], [step],
                      [("_imp_rn", "max", "_last", False)])
    staled = p2.withColumn("_stale", F.col("_rn") - F.coalesce("_last", F.lit(0)))
    stops = staled.where(F.col("_stale") == patience).groupBy(run).agg(F.min(step).alias("stop_step"))
    best = best_checkpoint(log, run, step, metric)
    n = log.groupBy(run).agg(F.count(F.lit(1)).alias("n_evals"))
    best, stops = best.withColumnRenamed(run, "_b"), stops.withColumnRenamed(run, "_s")
    return (n.join(best, n[run].eqNullSafe(best["_b"]), "left").join(stops, n[run].eqNullSafe(stops["_s"]), "left")
            .select(run, "stop_step", "best_step", "best_metric", "n_evals"))


def retain_last_k(log: DataFrame, run: str, step: str, metric: str, k: int) -> DataFrame:
    """Checkpoints kept by a ``save_total_limit=k`` rule with best-model
    tracking: the best step of each run and the newest others, ``k`` in all
    (for ``k`` = 1 the newest stays beside the best).  A run without any
    metric keeps its ``k`` newest.

    ``row_number() <= k`` is planned as a per-partition group limit before
    the shuffle, so at most k rows per run and partition move.
    """
    w = Window.partitionBy(run).orderBy(F.col(step).desc())
    newest = (log.select(run, step, metric).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(k, 2))
              .withColumn("_best", F.lit(False)))
    best = best_checkpoint(log, run, step, metric).select(
        run, F.col("best_step").alias(step), F.col("best_metric").alias(metric), F.lit(None).cast("int").alias("_rn"),
        F.lit(True).alias("_best"))
    # at most k + 1 rows per run from here on
    both = newest.unionByName(best).groupBy(run, step).agg(
        F.first(metric).alias(metric), F.min("_rn").alias("_rn"), F.max("_best").alias("_best"))
    per = Window.partitionBy(run)
    others = F.sum(F.when(~F.col("_best"), 1).otherwise(0)).over(
        per.orderBy(F.col(step).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("_tracked", F.max("_best").over(per)).withColumn("_others", others)
    room = F.when(F.col("_tracked"), F.lit(max(k - 1, 1))).otherwise(F.lit(k))
    return both.where(F.col("_best") | (F.col("_others") <= room)).select(
        run, step, metric, F.array_compact(F.array(
            F.when(F.col("_best"), F.lit("best")),
            F.when(F.col("_rn") <= F.when(F.col("_best"), k).otherwise(F.lit(max(k, 2))), F.lit("newest")))).alias("reasons"))


def label_runs(log: DataFrame, run: str, ts: str, direction, size, epochs, out: str = "run_name") -> DataFrame:
    """``(run, run_name)`` named after the run's first timestamp."""
    first = log.groupBy(run).agg(F.min(ts).alias("_t0"))
    return first.select(run, run_name(direction, size, epochs, F.col("_t0")).alias(out))
