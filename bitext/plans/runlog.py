"""Run-log plans over ``events``: run = user_id, step = event_id, metric =
value (evaluation log); job = event_type, ts (job log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import run_name
from ..operators import runs as R
from ..sources.tables import load_table, stream_table
from ..streaming.runlog import early_stop_stream, run_verdicts
from .corpus import scratch_path
from .registry import ORACLE_SQL, query

PATIENCE = 5      # smallest early-stopping patience of the reference
KEEP_LAST = 2     # save_total_limit of the reference's Marian trainers
DOC_BATCH = 32    # NLLB/mBART generation batch of the reference
RUN_LABEL = ("rin2eng", "3.5k", 30)  # direction, corpus size, epochs


def _evals(spark, data_dir):
    return load_table(spark, data_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("metric"),
        "ts")


@query("batch_number", sql=f"""
SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // {DOC_BATCH} AS BIGINT) AS batch_id
FROM documents
""")
def q_batch_number(spark: SparkSession, data_dir: str) -> DataFrame:
    """Consecutive batches of 32 documents per language in id order."""
    docs = load_table(spark, data_dir, "documents").select("doc_id", "lang")
    return R.batch_number(docs, ["lang"], ["doc_id"], DOC_BATCH)


@query("batch_number_null_key", sql=f"""
SELECT doc_id, k AS lang, CAST((row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1) // {DOC_BATCH} AS BIGINT) AS batch_id
FROM (SELECT doc_id, nullif(lang, 'en') AS k FROM documents)
""")
def q_batch_number_null_key(spark: SparkSession, data_dir: str) -> DataFrame:
    """Batches where one language is missing: null is a key like any other."""
    docs = load_table(spark, data_dir, "documents").select("doc_id", F.expr("nullif(lang, 'en')").alias("lang"))
    return R.batch_number(docs, ["lang"], ["doc_id"], DOC_BATCH)


@query("running_progress", sql="""
SELECT event_id, event_type, done, round(elapsed_s, 3) AS elapsed_s,
       round(CASE WHEN elapsed_s > 0 THEN done / elapsed_s END, 3) AS rows_per_s,
       round(CASE WHEN elapsed_s > 0 THEN (total - done) / (done / elapsed_s) END, 3) AS eta_s
FROM (
  SELECT event_id, event_type,
         count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done,
         count(*) OVER (PARTITION BY event_type) AS total,
         (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY event_type))) / CAST(1000000 AS DOUBLE) AS elapsed_s
  FROM events)
""")
def q_running_progress(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows done, rows/second and ETA after every record of each job
    (seconds reported to the millisecond)."""
    ev = load_table(spark, data_dir, "events").select("event_id", "event_type", "ts")
    p = R.running_progress(ev, "event_type", "ts", order="event_id")
    return p.select("event_id", "event_type", "done", F.round("elapsed_s", 3).alias("elapsed_s"),
                    F.round("rows_per_s", 3).alias("rows_per_s"), F.round("eta_s", 3).alias("eta_s"))


_IMP = ("CASE WHEN max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND 1 PRECEDING) IS NULL OR value > max(value) OVER (PARTITION BY user_id ORDER BY event_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END")
_BEST = """best AS (
  SELECT user_id, arg_max(event_id, struct_pack(m := value, s := -event_id)) AS best_step,
         max(value) AS best_metric
  FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY user_id)"""


@query("early_stop", sql=f"""
WITH f AS (SELECT user_id, event_id, value, {_IMP} AS imp FROM events),
g AS (SELECT *, sum(imp) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM f),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY event_id) - 1 AS stale FROM g),
stops AS (SELECT user_id, min(event_id) AS stop_step FROM s WHERE stale = {PATIENCE} GROUP BY user_id),
{_BEST}
SELECT n.user_id AS run_id, t.stop_step, b.best_step, b.best_metric, n.n_evals
FROM (SELECT user_id, count(*) AS n_evals FROM events GROUP BY user_id) n
LEFT JOIN best b ON b.user_id IS NOT DISTINCT FROM n.user_id
LEFT JOIN stops t ON t.user_id IS NOT DISTINCT FROM n.user_id
""")
def q_early_stop(spark: SparkSession, data_dir: str) -> DataFrame:
    """Step at which 5 evaluations in a row fail to beat the best BLEU."""
    return R.early_stop(_evals(spark, data_dir), "run_id", "step", "metric", PATIENCE)


@query("early_stop_stream")
def q_early_stop_stream(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same verdicts from the log read as a stream, one state per run."""
    verdicts = early_stop_stream(stream_table(spark, data_dir, "events"), "user_id", "event_id", "value", "ts", PATIENCE)
    out = run_verdicts(verdicts, scratch_path(spark, "verdicts"), scratch_path(spark, "verdicts-ckpt"))
    return out.select("run_id", "stop_step", "best_step", "best_metric", "n_evals")


ORACLE_SQL["early_stop_stream"] = ORACLE_SQL["early_stop"]


@query("best_checkpoint", sql=f"""
WITH {_BEST}
SELECT user_id AS run_id, best_step, best_metric FROM best
""")
def q_best_checkpoint(spark: SparkSession, data_dir: str) -> DataFrame:
    return R.best_checkpoint(_evals(spark, data_dir), "run_id", "step", "metric")


@query("retain_last_k", sql=f"""
WITH {_BEST},
newest AS (
  SELECT user_id, event_id, value, 'newest' AS why FROM (
    SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
    FROM events) WHERE rn <= {KEEP_LAST}),
ranked AS (
  SELECT e.user_id, e.event_id, e.value, e.event_id IS NOT DISTINCT FROM b.best_step AS is_best,
         row_number() OVER (PARTITION BY e.user_id ORDER BY (e.event_id IS NOT DISTINCT FROM b.best_step) DESC,
                            e.event_id DESC) AS place
  FROM events e LEFT JOIN best b ON b.user_id = e.user_id),
kept AS (
  SELECT r.user_id, r.event_id, r.value, 'best' AS why FROM ranked r WHERE is_best
  UNION ALL
  SELECT r.user_id, r.event_id, r.value, 'newest' FROM ranked r JOIN newest n
    ON n.user_id = r.user_id AND n.event_id = r.event_id WHERE place <= {KEEP_LAST}),
names AS (
  SELECT user_id, '{RUN_LABEL[0]}_{RUN_LABEL[1]}_{RUN_LABEL[2]}_run-' || strftime(min(ts), '%Y%m%d-%H%M%S') AS run_name
  FROM events GROUP BY user_id)
SELECT k.user_id AS run_id, n.run_name, k.event_id AS step, first(k.value) AS metric,
       string_agg(DISTINCT k.why, '+' ORDER BY k.why) AS reasons
FROM kept k JOIN names n ON n.user_id = k.user_id
GROUP BY k.user_id, n.run_name, k.event_id
""")
def q_retain_last_k(spark: SparkSession, data_dir: str) -> DataFrame:
    """Checkpoints kept by save_total_limit=2 with best-model tracking, each
    labelled with its run directory name."""
    ev = _evals(spark, data_dir)
    kept = R.retain_last_k(ev, "run_id", "step", "metric", KEEP_LAST)
    names = R.label_runs(ev, "run_id", "ts", *RUN_LABEL)
    names = names.withColumnRenamed("run_id", "_run")
    return kept.join(names, kept["run_id"].eqNullSafe(names["_run"])).select("run_id", "run_name", "step", "metric",
                                             F.array_join("reasons", "+").alias("reasons"))
