import math

from pyspark.sql import functions as F

from bitext.operators.lexicon import fit_lexicon, top_k, translate_tokens
from tests import refimpl as R

TINY = [  # bilingual_tiny
    (1, "la maison", "the house"),
    (2, "la maison bleue", "the blue house"),
    (3, "la fleur", "the flower"),
    (4, "maison", "house"),
]


def _check(spark, data, iterations, band):
    df = spark.createDataFrame(data, "k long, s string, t string")
    got = {(r["src_token"], r["tgt_token"]): r["p"]
           for r in fit_lexicon(df, "k", "s", "t", iterations, band).collect()}
    want = R.ibm1([(s, t) for _, s, t in data], iterations, band)
    assert set(got) == set(want)
    for key, p in want.items():
        assert math.isclose(got[key], p, abs_tol=1e-12), key
    return got


def test_ibm1_tiny_one_and_two_iterations(spark):
    one = _check(spark, TINY, 1, None)
    # maison: pair 1 gives 1/2 to each of 2 targets, pair 2 gives 1/3 to each of 3, pair 4 gives 1
    assert math.isclose(one[("maison", "house")], (0.5 + 1 / 3 + 1) / (0.5 * 2 + 1 / 3 * 3 + 1))
    two = _check(spark, TINY, 2, None)
    assert two[("maison", "house")] > one[("maison", "house")]


def test_banded_matches_bruteforce_and_rows_sum_to_one(spark):
    long_pairs = [(i, " ".join(f"s{(i * 7 + j) % 23}" for j in range(40)),
                   " ".join(f"t{(i * 7 + j) % 23}" for j in range(55))) for i in range(6)]
    got = _check(spark, long_pairs, 2, 3)
    sums = {}
    for (e, _), p in got.items():
        sums[e] = sums.get(e, 0.0) + p
    assert all(math.isclose(v, 1.0) for v in sums.values())


def test_small_source_band_equals_plain_ibm1(spark):
    df = spark.createDataFrame(TINY, "k long, s string, t string")
    a = {(r[0], r[1]): r[2] for r in fit_lexicon(df, "k", "s", "t", 2, 16).collect()}
    b = {(r[0], r[1]): r[2] for r in fit_lexicon(df, "k", "s", "t", 2, None).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)


def test_translate_keeps_order_and_copies_unknown(spark):
    lex = spark.createDataFrame([("la", "the", 0.9), ("la", "a", 0.1), ("maison", "house", 1.0)],
                                "src_token string, tgt_token string, p double")
    assert top_k(lex, 1).count() == 2
    df = spark.createDataFrame([(1, "La maison zzz la"), (2, ""), (3, None)], "k long, s string")
    out = {r["k"]: r["translation"] for r in translate_tokens(df, "k", "s", lex).collect()}
    assert out == {1: "the house zzz the", 2: "", 3: ""}


def test_top_k_tie_breaks_by_token(spark):
    lex = spark.createDataFrame([("x", "b", 0.5), ("x", "a", 0.5)], "src_token string, tgt_token string, p double")
    assert top_k(lex, 1).select("tgt_token").first()[0] == "a"
    assert top_k(lex, 5).where(F.col("rank") == 2).first()["tgt_token"] == "b"


def test_best_translation_equals_top1(spark):
    from bitext.operators.lexicon import best_translation
    rows = [("x", "b", 0.5), ("x", "a", 0.5), ("y", "c", 0.2), ("y", "d", 0.8), ("z", "e", 1 / 3),
            ("z", "f", 1 / 3 + 1e-15), ("z", "g", 1 / 3 - 1e-15)]
    lex = spark.createDataFrame(rows, "src_token string, tgt_token string, p double")
    a = sorted(map(tuple, best_translation(lex).collect()))
    b = sorted(map(tuple, top_k(lex, 1).select("src_token", "tgt_token").collect()))
    assert a == b == [("x", "a"), ("y", "d"), ("z", "e")]


def test_fit_lexicons_both_directions(spark):
    from bitext.operators.lexicon import fit_lexicons
    df = spark.createDataFrame(TINY, "k long, s string, t string")
    fwd, bwd = fit_lexicons(df, "k", "s", "t", 2, 16)
    a = {(r[0], r[1]): r[2] for r in fwd.collect()}
    b = {(r[0], r[1]): r[2] for r in bwd.collect()}
    want_a = R.ibm1([(s, t) for _, s, t in TINY], 2, 16)
    want_b = R.ibm1([(t, s) for _, s, t in TINY], 2, 16)
    assert a.keys() == want_a.keys() and b.keys() == want_b.keys()
    assert all(math.isclose(a[k], want_a[k]) for k in a) and all(math.isclose(b[k], want_b[k]) for k in b)


def test_fit_writes_words_not_word_pairs(spark):
    """The tables written for a fit grow with the texts and their words, not
    with the (source, target) pairs of words."""
    import os
    from bitext.session import checkpoint_dir
    data = [(i, " ".join(f"s{(i * 37 + j) % 400}" for j in range(60)), " ".join(f"t{(i * 53 + j) % 400}" for j in range(60)))
            for i in range(200)]
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = fit_lexicon(spark.createDataFrame(data, "k long, s string, t string"), "k", "s", "t", 3)
    assert out.count() > 50_000
    written = sum(spark.read.parquet(os.path.join(folder, d)).count() for d in set(os.listdir(folder)) - before if d.startswith("em-"))
    assert written < 5_000


def test_blocks_and_steps_of_any_size_give_the_same_lexicon(spark):
    from bitext.operators.lexicon import _fit_blocks, _prepare
    data = [(i, " ".join(f"s{(i * 7 + j) % 23}" for j in range(2 + i)), "common " * (1 + i % 3) + " ".join(f"t{(i * 5 + j) % 19}" for j in range(i)))
            for i in range(12)]
    data += [data[3], (None, "s1 s2", "common t1")]
    tok, dicts, hashed = _prepare(spark.createDataFrame(data, "k long, s string, t string"), "k", "s", "t", True, True)
    want = R.ibm1([(s, t) for _, s, t in data], 3, None)
    for block, step in ((100, 1), (50, 40), (10**6, 10**6)):
        got = {(r[0], r[1]): r[2] for r in _fit_blocks(tok, dicts, 3, None, True, block, step).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    least = {(r[0], r[1]): r[2] for r in _fit_blocks(tok, dicts, 3, 0.05, True).collect()}
    assert 0 < len(least) < len(want) and min(least.values()) >= 0.05


def test_memory_of_a_block_does_not_grow_with_its_pairs():
    """A block's pairs go through a task without staying in its memory; a word
    that all pairs have is worked in pieces."""
    import tracemalloc
    import numpy as np
    import pyarrow as pa
    from bitext.operators import lexicon as L
    rng = np.random.default_rng(2)
    e, f = (np.unique(rng.integers(-2**62, 2**62, 600)) for _ in range(2))

    def rows(n):
        """The words with their sums, then n pairs, all of which have f[0]."""
        some = np.array([None] * len(e), object)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(e), pa.int32()), pa.array([0] * len(e), pa.int32()), pa.array(e[:, None].tolist(), pa.list_(pa.int64())),
             pa.array(some, pa.list_(pa.int32())), pa.array(some, pa.list_(pa.int64())), pa.array(some, pa.list_(pa.int32())),
             pa.array(some, pa.list_(pa.string())), pa.array([[1.0]] * len(e), pa.list_(pa.float64()))],
            names=["_b", "kind", "s", "n", "f", "m", "token", "past"])
        for at in range(0, n, 100):
            s = [rng.choice(e, 40).tolist() for _ in range(100)]
            t = [[int(f[0]), *rng.choice(f, 39).tolist()] for _ in range(100)]
            yield from L._dealt(1)(iter([pa.record_batch([pa.array(s), pa.array(t)], names=["_s", "_t"])]))

    def peak(n):
        run = L._each_block(False, None, 10_000, 2, False, 1, n * 40 // 10_000 + 1)
        tracemalloc.start()
        found = pa.Table.from_batches(list(run(rows(n))))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # each pair's target words have n_f expected counts together
        assert math.isclose(sum(found["_c"].to_pylist()), 40 * n) and found.num_rows == len(e)
        return most

    peak(200)
    assert peak(6_000) < 1.5 * peak(1_000)


def test_best_keeps_what_top_k_returns_and_little_more(spark):
    data = [(i, " ".join(f"s{(i * 7 + j * j) % 41}" for j in range(3 + i % 9)),
             "common " * (1 + i % 3) + " ".join(f"t{(i * 5 + j) % 37} once{i}x{j}" for j in range(4 + i % 7))) for i in range(60)]
    data += [data[3], (None, "s1 s2 only", "common t1")]
    df = spark.createDataFrame(data, "k long, s string, t string")
    rows = lambda d: sorted((r["src_token"], r["rank"], r["tgt_token"], round(r["p"], 9)) for r in d.collect())
    whole = fit_lexicon(df, "k", "s", "t", 4).cache()
    for best in (1, 5):
        part = fit_lexicon(df, "k", "s", "t", 4, best=best).cache()
        assert rows(top_k(part, best)) == rows(top_k(whole, best))
        # what is left: the best, and what is equal to the last of them at 9 places
        least = top_k(whole, best).groupBy("src_token").agg(F.min("p").alias("least"))
        assert part.count() <= whole.join(least, "src_token").where("p >= least - 3e-9").count() < whole.count() / 2
    one = fit_lexicon(df, "k", "s", "t", 1, best=5)
    assert rows(top_k(one, 5)) == rows(top_k(fit_lexicon(df, "k", "s", "t", 1), 5))
    few = fit_lexicon(df, "k", "s", "t", 3, min_prob=0.05, best=5)
    assert rows(top_k(few, 5)) == rows(top_k(fit_lexicon(df, "k", "s", "t", 3, min_prob=0.05), 5))


def test_translation_shuffles_texts_not_their_words(spark):
    """Words of a text are no rows of a shuffle: a chunk asks once for each
    distinct word; texts of one key are merged and null keys stay empty."""
    from bitext.operators.translate import translate
    lex = spark.createDataFrame([("la", "the"), ("maison", "house"), ("mute", "")], "src_token string, tgt_token string")
    df = spark.createDataFrame([(1, "La maison zzz la"), (2, ""), (3, None), (4, "x mute y"), (4, "la maison la"), (None, "la"), (5, "... !"),
                                (6, "é_la 9")], "k long, s string")
    got = sorted(((r["k"], r["s"], r["o"]) for r in translate(df, "s", lex, "o", key="k").collect()), key=str)
    assert got == sorted([(1, "La maison zzz la", "the house zzz the"), (2, "", ""), (3, None, ""), (4, "x mute y", "the x  house the y"),
                          (4, "la maison la", "the x  house the y"), (None, "la", ""), (5, "... !", ""), (6, "é_la 9", "é the 9")], key=str)
    many = spark.range(400).select("id", F.lit("la maison zzz " * 500).alias("s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a large lexicon
    try:
        out = translate(many, "s", lex, "o", key="id")
        assert [r["o"] for r in out.collect()] == [("the house zzz " * 500).strip()] * 400
        assert _shuffled(out._jdf.queryExecution().executedPlan()) < 5_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _shuffled(node) -> int:
    """Rows that the shuffles of an executed plan wrote."""
    inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan"}.get(node.nodeName())
    if inner:
        return _shuffled(getattr(node, inner)())
    own = node.metrics().apply("shuffleRecordsWritten").value() if node.metrics().contains("shuffleRecordsWritten") else 0
    children = node.children()
    return own + sum(_shuffled(children.apply(i)) for i in range(children.size()))
