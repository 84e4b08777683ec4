"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from bitext.llm import rns_negatives as rns

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, row string"


def brute(rows, every, low=80, high=100, k=5, m=5):
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (a, va, ya) in enumerate(good):
        if a is None or a % every:
            continue
        scored = [(sum(p * q for p, q in zip(va, v)), i, y) for j, (i, v, y) in enumerate(good) if j != n]
        scored = [(max(-2**63, min(2**63 - 1, s)), i, y) for s, i, y in scored]
        for ps, p, _ in sorted((x for x in scored if x[2] == ya), key=order)[:k]:
            fit = sorted((x for x in scored if x[2] != ya and low * ps <= 100 * x[0] <= high * ps), key=order)[:m]
            out += [(a, p, r + 1, i, ps, s) for r, (s, i, _) in enumerate(fit)]
    return sorted(out, key=repr)


def found(spark, data, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)
    return sorted((tuple(r) for r in rns.hard_negatives(df, **more).collect()), key=repr)


@pytest.mark.parametrize("scale", [0.01, 1.0, 40.0])
def test_scores_are_exact(scale):
    rng = np.random.default_rng(3)
    a, b = (np.floor(256 * scale * rng.standard_normal((n, 70))) for n in (9, 13))
    assert (rns.scores(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    big = a * 2.0**70
    exact = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in big]
    assert rns.scores(big, b).tolist() == [[max(-2**63, min(2**63 - 1, x)) for x in row] for row in exact]


def test_negatives_equal_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, .3) for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(260):
        v = [x + rng.gauss(0, .02) for x in rng.choice(base)]
        rows.append((i, v, 0 if rng.random() < .5 else rng.randrange(4)))
    rows += [(10, rows[10][1], 1), (10, rows[10][1], 1), (300, rows[10][1], 2), (301, rows[10][1], 3)] * 3  # ties, repeats
    rows += [(None, rows[20][1], 1), (20, None, 1), (400, [0.1, None], 1), (410, [float("nan")] * 8, 1),
             (420, [float("inf")] * 8, 2), (430, rows[5][1], None), (440, [], 1), (450, rows[7][1][:3], 0),
             (460, [x * 1e30 for x in rows[7][1]], 0), (470, [0.0] * 8, 1)]
    rng.shuffle(rows)
    assert found(spark, rows, every=10, rows=32, anchors=8) == brute(rows, 10)
    assert found(spark, rows, every=10) == brute(rows, 10)


def test_copies_of_anchors_are_never_broadcast(spark):
    """Each block of rows gets a copy of the anchors, which Spark's estimate of
    their size does not count: gathered for a broadcast they fill the driver."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, .3) for _ in range(8)], i % 3) for i in range(120)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = rns.hard_negatives(df, every=4, rows=2, anchors=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [block" in plan and "BroadcastHashJoin [block" not in plan
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, 4)


def test_no_rows_no_anchors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert found(spark, [(100, [1.0], 0)]) == []
