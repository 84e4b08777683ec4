"""Early stop and progress of runs over an evaluation log that is still growing.

One state per run: what the settled evaluations gave (count, best, stale count,
stop), and the evaluations newer than the watermark (or than the run's newest row, less
the delay), which may still be preceded by late ones.  A verdict is the settled part with the open ones applied in step
order, so rows may arrive in any order within the watermark's delay, and the
verdicts after the last row are those of the batch operator ``early_stop``.
The state holds the open evaluations only, and the stream's checkpoint holds the
state, so a restart goes on where it was.

Cases: a null metric or NaN is an evaluation that improves nothing; a row later
than the watermark allows is counted in ``n_late`` and not applied once a newer
step of its run is settled; a run of a null key is a run; with ``idle`` a run
without new rows for so long is closed and its state dropped.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERDICT = ("run_id long, stop_step long, best_step long, best_metric double, n_evals long, n_late long, "
           "first_ms long, last_ms long, closed boolean")
_EMPTY = {"n": 0, "late": 0, "best": None, "best_step": None, "since": 0, "stop": None, "step": None,
          "first": None, "last": None}


def advance(run: dict, rows: list, patience: int) -> dict:
    """``run`` after evaluations (step, ms, metric) in step order."""
    run = dict(run)
    for step, _, metric in sorted(rows, key=lambda r: r[0]):
        run["n"] += 1
        run["step"] = step
        if metric is not None and (run["best"] is None or metric > run["best"]):
            run["best"], run["best_step"], run["since"] = metric, step, 0
        else:
            run["since"] += 1
            if run["since"] == patience and run["stop"] is None:
                run["stop"] = step
    return run


def early_stop_stream(log: DataFrame, run: str, step: str, metric: str, ts: str, patience: int,
                      delay_ms: int = 3_600_000, idle: int | None = None) -> DataFrame:
    """Streaming DataFrame of VERDICT, one row per run and micro-batch that
    touched it (update mode); ``idle`` in milliseconds of event time."""
    rows = (log.select(F.col(run).cast("long").alias("run_id"), F.col(step).cast("long").alias("step"),
                       F.col(metric).cast("double").alias("metric"), F.col(ts).cast("timestamp").alias("ts"))
            .withWatermark("ts", f"{delay_ms} milliseconds").withColumn("ms", F.unix_millis("ts")))

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else _EMPTY | {"open": []}
        closed = state.hasTimedOut
        horizon = state.getCurrentWatermarkMs()
        if not closed:
            for b in batches:
                for st, ms, m in zip(b["step"].tolist(), b["ms"].tolist(), b["metric"].tolist()):
                    m = None if m is None or math.isnan(m) else m
                    s["first"] = ms if s["first"] is None else min(s["first"], ms)
                    s["last"] = ms if s["last"] is None else max(s["last"], ms)
                    if s["step"] is not None and st <= s["step"]:
                        s["late"] += 1
                    else:
                        s["open"].append((st, ms, m))
        # a step is settled when it and all before it are older than the watermark, or than
        # the run's own newest row by as much, so a run's first batch does not all stay open
        if s["last"] is not None:
            horizon = max(horizon, s["last"] - delay_ms)
        ordered, n = sorted(s["open"], key=lambda r: r[0]), 0
        while n < len(ordered) and ordered[n][1] < horizon:
            n += 1
        s = advance(s, ordered[:n], patience) | {"open": ordered[n:]}
        now = advance(s, s["open"], patience)
        k = key[0]
        yield pd.DataFrame({"run_id": pd.array([None if pd.isna(k) else int(k)], "Int64"),
                            **{c: pd.array([now[f]], "Int64") for c, f in (("stop_step", "stop"), ("best_step", "best_step"))},
                            "best_metric": pd.array([now["best"]], "Float64"),
                            **{c: pd.array([now[f]], "Int64") for c, f in (("n_evals", "n"), ("n_late", "late"),
                                                                         ("first_ms", "first"), ("last_ms", "last"))},
                            "closed": [bool(closed)]})
        if closed:
            state.remove()
            return
        state.update((json.dumps(s),))
        if idle is not None:
            state.setTimeoutTimestamp(max(s["last"] + idle, state.getCurrentWatermarkMs() + 1))

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("run_id").applyInPandasWithState(update, VERDICT, "run string", "update", timeout)


def run_verdicts(verdicts: DataFrame, out_path: str, checkpoint_path: str, timeout_s: float | None = None) -> DataFrame:
    """Work off what the source holds now; the newest verdict of every run so
    far.  Each micro-batch overwrites its own folder, so a retry adds nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    q = (verdicts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    if not q.awaitTermination(timeout_s) and timeout_s is not None:
        q.stop()
        raise TimeoutError(f"the log was not worked off after {timeout_s} s; a rerun resumes it")
    spark = verdicts.sparkSession
    rows = spark.read.option("basePath", out_path).schema(VERDICT + ", batch_id long").parquet(out_path)
    fields = [f.split()[0] for f in VERDICT.split(", ")][1:]
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct(*fields), "batch_id").alias("v"))
    return newest.select("run_id", "v.*")
