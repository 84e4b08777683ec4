import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitext.operators import resample, wordvec
from bitext.sources import numbered_lines, zip_files
from bitext.streaming import early_stop_stream, run_verdicts
from bitext.operators import runs as R


def _brute_vectors(texts, size, dims, window):
    words = [t.split() for t in texts]
    n = Counter(w for t in words for w in t)
    vocab = sorted(w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:size])
    at = {w: i for i, w in enumerate(vocab)}
    c = np.zeros((len(vocab),) * 2)
    for t in words:
        for i, a in enumerate(t):
            for b in t[i + 1: i + 1 + window]:
                if a in at and b in at:
                    c[at[a], at[b]] += 1
                    c[at[b], at[a]] += 1
    s = c.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.maximum(np.nan_to_num(np.log(c * c.sum() / np.outer(s, s)), nan=0.0, neginf=0.0), 0)
    values, vectors = np.linalg.eigh(m)
    lead = np.argsort(-np.abs(values))[:dims]
    f = np.array([n[w] for w in vocab], float)
    weight = wordvec.SMOOTH / (wordvec.SMOOTH + f / f.sum())
    return at, m, vectors[:, lead] * np.sqrt(np.abs(values[lead])) * weight[:, None]


def test_sentence_vectors_equal_brute_force(spark):
    rng = random.Random(5)
    topics = [[f"{c}{i}" for i in range(8)] for c in "abcd"]
    texts = [" ".join(rng.choices(topics[k % 4], k=rng.randrange(2, 12)) + ["the"] * (k % 3)) for k in range(160)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    at, m, vectors = _brute_vectors(texts, 30, 4, 3)
    model = wordvec.fit_sentence_vectors(df, ["text"], size=30, dims=4, window=3, rounds=60)
    assert list(model.words) == sorted(at)
    # eigenvectors are equal up to sign: their products are equal
    assert np.allclose(model.vectors @ model.vectors.T, vectors @ vectors.T, atol=1e-6)
    split = [t.split() for t in texts]
    raw = np.array([vectors[[at[w] for w in t if w in at]].mean(axis=0) if any(w in at for w in t) else np.zeros(4) for t in split])
    lead = np.linalg.eigh(raw.T @ raw)[1][:, -1]
    want = raw - np.outer(raw @ lead, lead)
    got = model.encode([np.array(t, object) for t in split])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)
    pairs = spark.createDataFrame([(0, "a1 a2", "a3 a4"), (1, "a1 a2", "c3 c4"), (2, "a1", None), (3, "unknown", "a1"), (4, "", "")],
                                  "id long, x string, y string")
    sim = {r.id: r.similarity for r in wordvec.vector_similarity(pairs, model, "x", "y").collect()}
    assert sim[0] > 0.5 > sim[1] and sim[2] == sim[3] == sim[4] == 0.0
    none = wordvec.fit_sentence_vectors(df.limit(0), ["text"], size=30, dims=4)
    assert {r.similarity for r in wordvec.vector_similarity(pairs, none, "x", "y").collect()} == {0.0}
    with pytest.raises(ValueError):
        wordvec.fit_sentence_vectors(df, ["text"], size=10**7)


def test_products_are_packed_and_leave_nothing_on_the_driver(spark, monkeypatch):
    """The sums of a product come in a row a batch, not a row a word, and no
    block stays in the driver's memory."""
    import os
    from types import SimpleNamespace
    import pyarrow as pa
    rng = np.random.default_rng(1)
    dense = np.triu(rng.random((30, 30)) * (rng.random((30, 30)) < 0.7))
    dense = dense + dense.T
    a, b = np.nonzero(dense)
    x = rng.standard_normal((30, 3))
    rows = pa.record_batch([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(dense[a, b])], names=["a", "b", "w"])
    for size in (1, 7, 100, 10_000):  # words that lie in several batches
        batches = [rows.slice(i, size) for i in range(0, len(a), size)] + [rows.slice(0, 0)]
        out, found = np.zeros_like(x), list(wordvec._multiply(SimpleNamespace(value=x))(iter(batches)))
        for r in (r for f in found for r in f.to_pylist()):
            out[np.frombuffer(r["a"], np.int32)] += np.frombuffer(r["v"]).reshape(-1, 3)
        assert np.allclose(out, dense @ x) and sum(f.num_rows for f in found) <= min(30, len(batches) + 1)
    sent, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: sent.append(plain(self, v)) or sent[-1])
    matrix = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(a, b)], "a int, b int, w double")
    values, _ = wordvec.leading_vectors(matrix, 30, 2, rounds=40)
    want = np.linalg.eigvalsh(dense)
    assert np.allclose(values, want[np.argsort(-np.abs(want))[:2]])
    assert len(sent) == 41 and not any(os.path.exists(s._path) for s in sent)


def test_poisson_weights():
    cuts = resample.poisson_cuts()
    p = np.diff([0, *cuts, 2**32]) / 2**32
    assert np.allclose(p[:6], [math.exp(-1) / math.factorial(k) for k in range(6)], atol=1e-9)


def test_score_intervals(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random() - 0.3 if i % 9 else None) for i in range(400)] + [(400, float("nan"), 0.1)]
    df = spark.createDataFrame(rows, "id long, good double, bad double")
    out = {r.system: r for r in resample.score_intervals(df, "id", ["good", "bad"], 100).collect()}
    good = [r[1] for r in rows[:400]]
    assert out["good"]["mean"] == pytest.approx(sum(good) / 400) and out["good"].p_first == 1.0
    assert out["bad"]["mean"] == pytest.approx(np.mean([r[2] for r in rows if r[2] is not None])) and out["bad"].p_first == 0.0
    sd = np.std(good) / 20
    assert 2.5 * sd < out["good"].high - out["good"].low < 5.5 * sd and out["good"].low < out["good"].median < out["good"].high


def test_zip_files(spark, tmp_path):
    rng = random.Random(2)
    a = [rng.choice(["", " ", "x" * rng.randrange(60)]) + str(i) * (i % 7 > 0) for i in range(5000)]
    b = [f"line {i}" for i in range(5000)]
    for name, rows, cuts in (("a", a, [0, 13, 13, 4000, 5000]), ("b", b, [0, 2500, 5000])):
        (tmp_path / name).mkdir()
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / name / f"part-{k:05d}").write_text("".join(x + "\n" for x in rows[lo:hi]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "7000"):  # splits within files, and several files in a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = zip_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).orderBy("line_no").collect()
            assert [(r.line_no, r.src, r.tgt) for r in got] == [(i, x, y) for i, (x, y) in enumerate(zip(a, b))]
            rest = numbered_lines(spark, str(tmp_path / "b"), header=True).orderBy("line_no").first()
            assert (rest.line_no, rest.line) == (0, "line 1")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "short").write_text("one\n")
    with pytest.raises(ValueError):
        zip_files(spark, str(tmp_path / "a"), str(tmp_path / "short"))


def test_early_stop_stream_after_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(run, step, rng.choice([None, float("nan"), round(rng.random(), 2)]), 1_700_000_000 + step * 60 + rng.randrange(30))
            for run in (*range(20), None) for step in range(60)]
    rows.sort(key=lambda r: r[3] + rng.randrange(600))  # up to ten minutes late
    schema = "run long, step long, metric double, sec long"
    src, out, ck = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    full = spark.createDataFrame(rows, schema)
    for k in range(3):  # the stream stops after each part and a new one goes on
        (spark.createDataFrame(rows[k * 420: k * 420 + 420], schema).withColumn("ts", F.timestamp_seconds("sec"))
         .coalesce(1).write.parquet(str(src / f"p{k}")))
        log = spark.readStream.schema("run long, step long, metric double, sec long, ts timestamp").parquet(f"{src}/*")
        now = run_verdicts(early_stop_stream(log, "run", "step", "metric", "ts", 5, delay_ms=900_000), out, ck, 120)
        seen = R.early_stop(full.limit(0).unionByName(spark.createDataFrame(rows[: k * 420 + 420], schema)), "run", "step", "metric", 5)
        cols = ["run", "stop_step", "best_step", "best_metric", "n_evals"]
        got = {tuple(r) for r in now.withColumnRenamed("run_id", "run").select(cols).collect()}
        assert got == {tuple(r) for r in seen.select(cols).collect()}
    assert {r.n_late for r in now.collect()} == {0} and not any(r.closed for r in now.collect())
