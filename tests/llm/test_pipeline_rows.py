"""run() against a plain version of its stages on a small table with planted cases."""

import random
from collections import Counter

import corpus_pipeline
from bitext.llm import odd_sketch
from tests.llm.test_documents import WORD, brute_counts, brute_groups, text

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _size string, _copies string, _gone string, row string, k1 string"


def planted():
    rng = random.Random(9)
    row = lambda i, t, s: (i, t, "en", s, len(t or ""), "a", "b", "c", "d", "e")
    good = [text(rng, 120) for _ in range(60)]
    item = text(rng, 30, vocab=500)
    rows = [row(i, t, f"s{i % 3}") for i, t in enumerate(good)]
    rows += [row(100 + i, good[i], "s1") for i in range(10)]  # exact copies
    rows += [row(120 + i, good[20 + i] + " and so on", None) for i in range(10)]  # near copies
    rows += [row(200 + i, text(rng, 40) + " " + item + " " + text(rng, 40), "s0") for i in range(5)]  # leaks
    rows += [row(300, "too short", "s0"), row(301, None, "s0"), row(302, "", "s2"), row(303, "x y z " * 60, "s1")]  # rejected
    rows += [rows[3]] * 2  # repeated rows
    lone = text(rng, 90)
    rows += [row(None, lone, "s2")] * 3  # copies without an id
    return rows, item


def test_pipeline_equals_plain_version(spark, tmp_path):
    rows, item = planted()
    sf = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.run(spark, sf).collect()

    def bad(t):  # no labels: the base rules alone
        n, _, _, _, repeated = brute_counts(t)
        return n < 50 or 100 * repeated > 50 * n
    left = [r for r in dict.fromkeys(rows) if not bad(r[1])]
    group = brute_groups([(r[0], r[1]) for r in left], 5)
    left = [r for r in left if r[0] is None or group[r[0]][1] == r[0]]
    left = [r for r in left if item not in r[1]]
    found = Counter(tuple(r)[:len(rows[0])] for r in out)
    assert set(found) <= set(left) and max(found.values()) <= 2
    # the mix: 150 % of all words, by weight over the sources, within half a document of each target
    size = Counter()
    for r in left:
        size[r[3]] += len(WORD.findall(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full, budget = {}, set(), 1.5 * sum(size.values())
    while True:
        open_ = [s for s in order if s not in full]
        free = budget - sum(2 * size[s] for s in full)
        target = {s: 2.0 * size[s] if s in full else free * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = {s for s in open_ if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r, n in found.items():
        taken[r[3]] += n * len(WORD.findall(r[1]))
    longest = max(len(WORD.findall(r[1])) for r in left)
    assert all(abs(taken[s] - target[s]) <= longest for s in order)
    assert {r.shard for r in out} and out[0].asDict().keys() >= {"slot", "shard"}


def test_rows_of_one_id_are_one_document(frame):
    rng = random.Random(3)
    a, b = text(rng, 100), text(rng, 100)
    rows = [(5, a), (1, a + " more"), (5, b), (9, b + " more"), (12, text(rng, 100))]
    got = sorted(tuple(r)[::2] for r in odd_sketch.near_duplicates(frame(rows)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == [(1, 1), (5, 1), (5, 1), (9, 1), (12, 12)]


def test_same_id_and_size_in_two_sources(spark):
    """A row's copies are its own, not those of a row of equal id and size."""
    t = ["one two three " * 30, "four five six " * 30]
    rows = [(1, t[0], "en", "s1", 1, *"abcde"), (1, t[1], "en", "s2", 1, *"abcde")]
    docs = spark.createDataFrame([*rows, *[(10 + i, text(random.Random(i), 200), "en", "s1", 1, *"abcde") for i in range(9)]], COLUMNS)
    from bitext.llm import es_mixing
    want = {(r.doc_id, r.k1): r.copies for r in es_mixing.mix(docs.drop("k1").withColumnRenamed("row", "r").withColumn("k1", docs.source), keep=("k1",)).collect()}
    got = Counter((r.doc_id, r.source) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert got == Counter({k: v for k, v in want.items() if v})
