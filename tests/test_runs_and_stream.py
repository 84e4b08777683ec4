import os

from pyspark.sql import functions as F

from bitext.operators import runs as R
from bitext.streaming import incremental_translate

LOG = [  # eval_log: run 1 stops by patience 2 at step 500; run 2 never stops; tie on best in run 3
    (1, 100, 10.0), (1, 200, 12.0), (1, 300, 11.0), (1, 400, 12.0), (1, 500, 9.0), (1, 600, 13.0),
    (2, 100, 1.0), (2, 200, 2.0), (2, 300, 3.0),
    (3, 100, 5.0), (3, 200, 7.0), (3, 300, 7.0),
]


def test_best_and_early_stop(spark):
    df = spark.createDataFrame(LOG, "run long, step long, bleu double")
    best = dict((r["run"], (r["best_step"], r["best_metric"])) for r in R.best_checkpoint(df, "run", "step", "bleu").collect())
    assert best == {1: (600, 13.0), 2: (300, 3.0), 3: (200, 7.0)}
    stop = dict((r["run"], r["stop_step"]) for r in R.early_stop(df, "run", "step", "bleu", 2).collect())
    assert stop == {1: 400, 2: None, 3: None}
    stop3 = dict((r["run"], r["stop_step"]) for r in R.early_stop(df, "run", "step", "bleu", 3).collect())
    assert stop3[1] == 500


def test_retain_last_k(spark):
    df = spark.createDataFrame(LOG, "run long, step long, bleu double")
    kept = R.retain_last_k(df, "run", "step", "bleu", 2).collect()
    got = sorted((r["run"], r["step"], tuple(r["reasons"])) for r in kept)
    assert (1, 600, ("best", "newest")) in got and (1, 500, ("newest",)) in got
    assert (3, 200, ("best", "newest")) in got and len([g for g in got if g[0] == 1]) == 2


def test_batch_number_and_progress(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(20)], "id long, k string")
    b = R.batch_number(df, ["k"], ["id"], 4).collect()
    a_rows = sorted((r["id"], r["batch_id"]) for r in b if r["k"] == "a")
    assert [x[1] for x in a_rows] == [i // 4 for i in range(len(a_rows))]
    log = spark.createDataFrame([("j", "2024-01-01 00:00:00", 10), ("j", "2024-01-01 00:00:00", 10),
                                 ("j", "2024-01-01 00:00:10", 20)], "job string, ts string, rows int")
    log = log.withColumn("ts", F.to_timestamp("ts"))
    p = R.running_progress(log, "job", "ts", rows="rows").orderBy("done").collect()
    assert [r["done"] for r in p] == [10, 20, 40] and p[0]["rows_per_s"] is None
    assert p[-1]["rows_per_s"] == 4.0 and p[-1]["eta_s"] == 0.0


def test_incremental_translate_restartable(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([(1, "hello world")], "id long, text string").write.parquet(str(src / "a"))
    lex = spark.createDataFrame([("hello", "kumusta", 1.0)], "src_token string, tgt_token string, p double")
    from bitext.operators.translate import translate
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        stream = spark.readStream.schema("id long, text string").parquet(str(src) + "/*")
        q = incremental_translate(spark, stream, lambda d: d,
                                  lambda b: translate(b, "text", lex, "tl", key="id"), out, ck)
        return q.recentProgress
    run()
    spark.createDataFrame([(2, "world hello")], "id long, text string").write.parquet(str(src / "b"))
    prog = run()  # restart: only the new file is processed
    assert sum(p["numInputRows"] for p in prog) == 1
    got = sorted((r["id"], r["tl"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "kumusta world"), (2, "world kumusta")]


def test_early_stop_after_shuffle(spark):
    # input arriving from a shuffle (no fixed row order) must give the same result
    import random
    rnd = random.Random(7)
    rows = [(r, s, float(rnd.randint(0, 30))) for r in range(20) for s in range(0, 3000, 10)]
    df = spark.createDataFrame(rows, "run long, step long, bleu double").repartition(5, "step")
    got = dict((r["run"], r["stop_step"]) for r in R.early_stop(df, "run", "step", "bleu", 4).collect())
    want = {}
    for run in range(20):
        best, stale, stop = None, 0, None
        for _, s, v in sorted(x for x in rows if x[0] == run):
            if best is None or v > best:
                best, stale = v, 0
            else:
                stale += 1
                if stale == 4 and stop is None:
                    stop = s
        want[run] = stop
    assert got == want
