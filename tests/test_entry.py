import __spark_entry__ as E


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["pair_id", "sentence", "synthetic", "similarity"]
    rows = df.collect()
    assert len(rows) > 0 and all(0.0 <= r["similarity"] <= 1.0 for r in rows)
    assert all(r["synthetic"] == "" or r["similarity"] >= 0.7 for r in rows)


def test_registry_shape():
    q, sql = E.queries(), E.oracle_sql()
    assert "round_trip_gate" in q and set(sql) <= set(q)
    assert len(q) >= 40


def test_some_queries_small(spark):
    q = E.queries()
    for name in ("clean_lines", "split_exact", "best_checkpoint", "bleu_corpus", "dense_cosine"):
        assert q[name](spark, "/root/testdata/sf0.001").count() >= 1
