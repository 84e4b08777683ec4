"""Registered queries and the pipeline on the smallest tables."""

import corpus_pipeline
import __spark_entry__ as entry
from bitext.llm import odd_sketch, queries
from bitext.llm.registry import table

SF_SMALL = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == [*range(1, 14)]
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


def test_pipeline(spark):
    docs = table(spark, SF_SMALL, "documents")
    last = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, last, SF_SMALL)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        last = out.cache()
        if i == 1:  # one document of each group is left
            assert odd_sketch.near_duplicates(last).filter("not kept").count() == 0
    assert {"slot", "shard"} < set(last.columns) and last.count() > 0
    mixed = last.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert mixed <= 2
