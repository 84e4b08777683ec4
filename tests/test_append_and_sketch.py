"""Append sink under failures, mergeable score sketches, counts by observation."""

import math
import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.operators.counting import StageCounts
from bitext.operators.metrics import count_rows
from bitext.operators.sketch import merge_sketches, score_sketch, sketch_quantiles, sketch_threshold
from bitext.sources.append import Ledger, append_rows, appended_epochs, read_appended
from bitext.streaming import append_progress, append_stream

CELLS = [(1, "plain", "x"), (2, 'tab\tand "quote"', ""), (3, "two\nlines", None), (4, "", "é"), (5, None, "None"), (6, "null", "\r\n")]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("header", [False, True])
def test_batch_appends_once(spark, tmp_path, header):
    path, schema = str(tmp_path / "out"), "id long, a string, b string"
    df = spark.createDataFrame(CELLS, schema).repartition(3)
    append_rows(df, path, "monday", header=header)
    append_rows(df, path, "monday", header=header)  # the job ran again
    assert rows_of(read_appended(spark, path, schema, header=header)) == Counter(CELLS)
    append_rows(df.where("id < 3"), path, "tuesday", header=header)
    append_rows(df.where("id > 99"), path, "empty", header=header)
    assert rows_of(read_appended(spark, path, schema, header=header)) == Counter(CELLS) + Counter(CELLS[:2])
    assert {r.epoch: r.n_rows for r in appended_epochs(spark, path).collect()} == {"monday": 6, "tuesday": 2, "empty": 0}
    with pytest.raises(Exception, match="the sink has columns"):
        append_rows(df.select("id", F.col("a").alias("other"), "b"), path, "wednesday", header=header)
    assert os.listdir(f"{path}/staged") == []
    with pytest.raises(Exception, match="option epoch"):
        append_rows(df, path, "", header=header)


def test_one_column(spark, tmp_path):
    path = str(tmp_path / "out")
    append_rows(spark.createDataFrame([("a",), (None,), ("",)], "t string").coalesce(1), path, "1")
    assert rows_of(read_appended(spark, path, "t string")) == Counter([("a",), ("",), ("",)])


def test_death_between_entry_and_moves(tmp_path):

    log = Ledger(str(tmp_path / "out"))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "t": ["a", "b"]})
    parts = [log.stage([batch]), log.stage([batch, batch]), log.stage([])]
    real = log.fs

    class Once:  # the file system fails at the second move into rows
        moved = 0

        def __getattr__(self, name):
            return getattr(real, name)

        def move(self, src, dst):
            if "/rows/" in dst:
                Once.moved += 1
                if Once.moved == 2:
                    raise OSError("killed")
            real.move(src, dst)

    log.fs = Once()
    with pytest.raises(OSError):
        log.commit("0", parts)
    again = Ledger(str(tmp_path / "out"))
    retry = [again.stage([batch]), again.stage([batch, batch])]  # the epoch is worked again
    again.commit("0", retry)
    files = sorted(os.listdir(tmp_path / "out" / "rows"))
    assert files == ["0-00000.csv", "0-00001.csv"] and os.listdir(tmp_path / "out" / "staged") == []
    assert sum(len((tmp_path / "out" / "rows" / f).read_text().splitlines()) for f in files) == 6


def test_stream_killed_in_a_batch(spark, tmp_path):
    """A task dies in the middle of the first epoch, later the job dies between
    the sink's commit and the stream's: each row is there once."""
    src, out, ck, flag = (str(tmp_path / n) for n in ("in", "out", "ck", "flag"))
    spark.range(0, 500, 1, 4).selectExpr("id", "concat('t', id) AS t").write.parquet(f"{src}/a")

    def fragile(batches):
        for batch in batches:
            if not os.path.exists(flag) and 333 in batch.column("id").to_pylist():
                raise RuntimeError("executor lost")
            yield batch

    def run():
        stream = spark.readStream.schema("id long, t string").parquet(f"{src}/*").mapInArrow(fragile, "id long, t string")
        return append_stream(stream, out, ck)

    with pytest.raises(Exception):
        run()
    assert os.listdir(f"{out}/rows") == []
    open(flag, "w").close()
    run()
    os.remove(f"{ck}/commits/0")  # as if it had died just before noting the epoch
    for crc in [f for f in os.listdir(f"{ck}/commits") if f.endswith(".crc")]:
        os.remove(f"{ck}/commits/{crc}")
    run()
    schema = "id long, t string"
    assert rows_of(read_appended(spark, out, schema)) == Counter((i, f"t{i}") for i in range(500))
    spark.range(500, 600).selectExpr("id", "concat('t', id) AS t").write.parquet(f"{src}/b")
    run()
    assert rows_of(read_appended(spark, out, schema)) == Counter((i, f"t{i}") for i in range(600))
    done = append_progress(spark, out, total_rows=1000).orderBy("done").collect()
    assert [r.done for r in done] == [500, 600] and done[0].rows_per_s is None and done[1].eta_s > 0


def test_stream_of_nothing(spark, tmp_path):
    spark.range(0).selectExpr("id", "'x' AS t").write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema("id long, t string").parquet(f"{tmp_path}/in/*")
    append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert read_appended(spark, f"{tmp_path}/out", "id long, t string").count() == 0


def test_table_of_many_files_as_stream(spark, tmp_path):
    from bitext.plans import ORACLE_SQL, QUERIES, catalog  # noqa: F401
    rows = [(i, f"line {i}\n\nsecond {i}", None if i % 3 else "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.repartition(5).write.parquet(f"{tmp_path}/many/documents.parquet")
    df.coalesce(1).write.parquet(f"{tmp_path}/tmp")
    (tmp_path / "one").mkdir()
    part = [f for f in os.listdir(tmp_path / "tmp") if f.endswith(".parquet")][0]
    (tmp_path / "one" / "documents.parquet").write_bytes((tmp_path / "tmp" / part).read_bytes())
    got = [rows_of(QUERIES["append_stream"](spark, str(tmp_path / d))) for d in ("many", "one")]
    assert got[0] == got[1] and sum(got[0].values()) == 80


def test_sketch_against_sorted_scores(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.uniform(-1, 1), round(rng.gauss(0.7, 0.1), 2)])) for g in ("a", "b", None) for _ in range(700)]
    rows += [("a", None), ("a", float("nan")), ("b", 1.0), ("b", -1.0), ("b", 7.0), ("few", 0.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, similarity double")
    parts = [score_sketch(df.where(F.abs(F.xxhash64("similarity")) % 3 == k), ["g"]) for k in range(3)]
    merged = merge_sketches(parts, ["g"])
    assert rows_of(merged.select("g", "bin", "n")) == rows_of(score_sketch(df, ["g"]).select("g", "bin", "n"))
    quantiles = {r.g: r for r in sketch_quantiles(merged, ["g"], (1, 10, 50, 90, 100)).collect()}
    limits = {r.g: r for r in sketch_threshold(merged, ["g"], 100).collect()}
    for g in ("a", "b", None, "few"):
        xs = sorted(min(max(x, -1.0), 1.0) for k, x in rows if k == g and x is not None and not math.isnan(x))
        q = quantiles[g]
        assert q.n == len(xs) and q.n_null == (2 if g == "a" else 0)
        for p in (1, 10, 50, 90, 100):
            assert abs(q[f"p{p}"] - xs[math.ceil(len(xs) * p / 100) - 1]) <= 1 / 4096
        t = limits[g]
        assert t.accepted == sum(x >= t.threshold for x in xs)
        if len(xs) < 100:
            assert (t.threshold, t.accepted) == (-1.0, len(xs))
        else:  # one step higher would accept too few
            assert t.accepted >= 100 > sum(x >= t.threshold + 2 / 4096 for x in xs)
    assert quantiles["none"].p50 is None and quantiles["none"].n_null == 1 and "none" not in limits
    assert merge_sketches([score_sketch(df.limit(0), ["g"])], ["g"]).count() == 0


def test_observed_counts(spark, tmp_path):
    counts = StageCounts()
    df = counts.watch(spark.range(0, 1000, 1, 7), "read")
    kept = counts.watch(df.where("id % 3 = 0"), "kept", {"even": F.col("id") % 2 == 0})
    kept.write.parquet(str(tmp_path / "t"))
    table = {r.stage: r.n_rows for r in counts.table(spark).collect()}
    written = spark.read.parquet(str(tmp_path / "t"))
    assert table == {"read": 1000, "kept": count_rows(written).first().n_rows, "even": written.where("id % 2 = 0").count()}
    assert isinstance(counts.table(spark).schema["n_rows"].dataType, T.LongType)
    none = StageCounts()
    none.watch(spark.range(0), "empty").write.parquet(str(tmp_path / "e"))
    assert [tuple(r) for r in none.table(spark).collect()] == [("empty", 0)]
