"""A corpus pipeline over ``documents``: quality rules, near-duplicate removal,
benchmark decontamination, mixing of sources, sharding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; what it returns is
written as Parquet and read again as the next stage's docs.  All stages but
the last return the columns of ``documents``; the last adds slot and shard.
Rows that share a doc_id are one document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.llm import es_mixing, lsa_decontam, maglev, odd_sketch, risk_rules
from bitext.llm.registry import table
from bitext.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    return risk_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def _rows(docs: DataFrame, *key) -> DataFrame:
    """Rows as one column and 128 bits of hash of ``key``, so no name of the
    documents can clash with a helper's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"),
                       F.xxhash64(F.lit(1), *key).alias("k1"), F.xxhash64(F.lit(2), *key).alias("k2"))


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, 0.8) stays,
    of repeated rows (equal doc_id and text, null ids included) one row."""
    groups = odd_sketch.near_duplicates(docs)
    gone = groups.filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    # columns that xxhash64 takes with a mark for null: (1, null) and (null, 1) differ
    rows = _rows(docs, F.struct("doc_id", "text", F.col("doc_id").isNull()))
    rows = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    twice = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2")
    twice = materialize(twice, "pipeline-twice")
    one = rows.join(twice, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return _columns(rows.join(twice, ["k1", "k2"], "left_anti").select("row").unionByName(one.select("row")), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return lsa_decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is repeated as often as the mix takes it (0, 1 or 2); rows equal
    in doc_id, source and text as often as the mix takes one of them at most."""
    key = F.struct("doc_id", "source", "text", F.col("doc_id").isNull(), F.col("source").isNull())
    rows = _rows(docs, key)
    taken = es_mixing.mix(rows.select("row.doc_id", "row.source", "row.text", "k1", "k2"), keep=("k1", "k2"))
    taken = taken.filter("copies > 0").groupBy("k1", "k2").agg(F.max("copies").alias("copies"))
    return _columns(rows.join(taken, ["k1", "k2"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every row on one of the shards."""
    return maglev.place(docs, maglev.shard_names(maglev.N_SHARDS))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: The binomial tests, MinHash and the SVD have no SQL form; tests/llm compares
#: run() with a plain version on a small table with planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
