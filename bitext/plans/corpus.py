"""Corpus plans: scans, sinks, cleaning, contracts, orientation, splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PANDAS_NA, strip
from ..operators import clean as C
from ..operators.ordering import row_number_by
from ..operators.pairs import clean_pairs, part_key, table_from_columns, turn_pairs, with_row_id, zip_rows
from ..operators.split import SEED, TEST_SIZE, split_exact, split_hash
from ..session import checkpoint_dir
from ..sources.aligned import zip_files
from ..sources.contracts import require_columns
from ..sources.csv import scan_csv, sink_csv, sink_tsv
from ..sources.lines import clean_lines
from ..sources.tables import load_table
from . import sqlparts as S
from .registry import query


def split_lines(docs: DataFrame) -> DataFrame:
    """``(line_id, doc_id, lang, line)``: documents split on line breaks (as
    Python's universal newlines do), stripped, blank lines dropped."""
    ex = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\\r\\n|\\r|\\n")).alias("k", "value"))
    lines = ex.select(part_key("doc_id", "k").alias("line_id"), "doc_id", "lang", strip("value").alias("line"))
    return lines.where(F.col("line").isNotNull() & (F.col("line") != ""))


def doc_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """The lines of ``documents``."""
    return split_lines(load_table(spark, data_dir, "documents"))


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@query("clean_lines", sql=f"""
WITH {S.doc_lines_cte()}
SELECT lang, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars,
       count(DISTINCT doc_id) AS n_docs
FROM lines GROUP BY lang
""")
def q_clean_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    lines = doc_lines(spark, data_dir)
    return lines.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"),
                                     F.sum(F.length("line")).cast("long").alias("n_chars"),
                                     F.countDistinct("doc_id").alias("n_docs"))


_NA_LIST = ", ".join("'" + v.replace("'", "''") + "'" for v in PANDAS_NA)
DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("text", T.StringType())])


@query("csv_round_trip", sql=f"""
SELECT doc_id, lang, source, CASE WHEN text IN ({_NA_LIST}) THEN NULL ELSE text END AS text
FROM documents
""")
def q_csv_round_trip(spark: SparkSession, data_dir: str) -> DataFrame:
    """Write documents as CSV (quotes, commas and newlines inside cells) and
    read them back with pandas-compatible NA literals."""
    path = scratch_path(spark, "csv")
    sink_csv(load_table(spark, data_dir, "documents").select("doc_id", "lang", "source", "text"), path)
    return scan_csv(spark, path, DOC_SCHEMA)


@query("csv_reordered", sql=f"""
SELECT doc_id, lang, source, CASE WHEN text IN ({_NA_LIST}) THEN NULL ELSE text END AS text
FROM documents
""")
def q_csv_reordered(spark: SparkSession, data_dir: str) -> DataFrame:
    """Columns are found by name: a file written in another column order."""
    path = scratch_path(spark, "csv-reordered")
    sink_csv(load_table(spark, data_dir, "documents").select("text", "source", "lang", "doc_id"), path)
    return scan_csv(spark, path, DOC_SCHEMA)


@query("column_picks", sql="""
WITH t AS (SELECT text AS sentence, lang AS language FROM documents WHERE lang IS NOT NULL)
SELECT 'named' AS rule, language AS value, count(*) AS n FROM t GROUP BY language
UNION ALL
SELECT 'first', sentence, count(*) FROM t GROUP BY sentence
""")
def q_column_picks(spark: SparkSession, data_dir: str) -> DataFrame:
    """A table built from columns, rows without a language dropped, then a
    column picked by name and, where the name is absent, the first one."""
    t = table_from_columns(load_table(spark, data_dir, "documents"), {"sentence": "text", "language": "lang"})
    t = C.not_null(t, "language")
    picks = [C.pick_or_first(t, name, "value").withColumn("rule", F.lit(rule))
             for rule, name in (("named", "language"), ("first", "absent"))]
    return picks[0].unionByName(picks[1]).groupBy("rule", "value").agg(F.count(F.lit(1)).alias("n"))


@query("scan_lines", sql=f"""
WITH {S.doc_lines_cte()}
SELECT line AS sentence, count(*) AS n FROM lines GROUP BY line
""")
def q_scan_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """Raw-line scan: documents written as a text file, read back line by line,
    stripped, blanks dropped; multiplicity per distinct line."""
    path = scratch_path(spark, "lines")
    load_table(spark, data_dir, "documents").select("text").write.mode("overwrite").text(path)
    lines = clean_lines(spark.read.text(path), "value", "sentence")
    return lines.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))


@query("zip_rows", sql="""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, lang, n_chars
FROM documents
""")
def q_zip_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    """Two projections of one table re-paired on an explicit row id."""
    docs = load_table(spark, data_dir, "documents")
    numbered = with_row_id(docs.select("doc_id", "lang", "n_chars"), ["doc_id"], "row_id")
    left = numbered.select("row_id", "doc_id", "lang")
    right = numbered.select("row_id", "n_chars")
    return zip_rows(left, right, "row_id").select("row_id", "doc_id", "lang", "n_chars")


_ONE_LINE = "regexp_replace({}, '[\\r\\n]+', ' ', 'g')"


@query("zip_files", sql=f"""
WITH {S.turn_pairs_cte()}
SELECT {_ONE_LINE.format('src')} AS src, {_ONE_LINE.format('tgt')} AS tgt FROM pairs
""")
def q_zip_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """Both sides of the turn pairs written apart as text, in one order but cut
    into other files, and paired again by line number."""
    pairs = clean_pairs(turn_pairs(load_table(spark, data_dir, "conversations")))
    paths = []
    for side, files in (("src", 3), ("tgt", 5)):
        path = scratch_path(spark, f"zip-{side}")
        (pairs.select("conv_id", "turn", F.regexp_replace(side, "[\\r\\n]+", " ").alias("value"))
         .repartitionByRange(files, "conv_id", "turn", "value").sortWithinPartitions("conv_id", "turn", "value")
         .select("value").write.mode("overwrite").text(path))
        paths.append(path)
    return zip_files(spark, *paths).select("src", "tgt")


@query("orient_pairs", sql=f"""
WITH {S.turn_pairs_cte()}
SELECT pair_id, 'user2assistant' AS direction, src, tgt, 'real' AS origin FROM pairs
UNION ALL
SELECT pair_id, 'assistant2user', tgt, src, 'real' FROM pairs
""")
def q_orient_pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rename to a scheme of the reference (sentence, rinconada), harmonise it
    back to (src, tgt), check the contract, emit both directions."""
    pairs = clean_pairs(turn_pairs(load_table(spark, data_dir, "conversations")))
    named = C.rename(pairs, {"src": "sentence", "tgt": "rinconada", "absent": "ignored"})
    unified = C.harmonise(named, origin="real", keep=["pair_id"])
    require_columns(unified, ["src", "tgt"])
    both = C.both_directions(unified, "src", "tgt", keep=["pair_id", "origin", "similarity"],
                             names=("user2assistant", "assistant2user"))
    both = C.drop_raw(both, ["similarity"])
    return both.select("pair_id", "direction", "src", "tgt", "origin")


def _open_pairs(spark, data_dir):
    conv = load_table(spark, data_dir, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    a = conv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                         F.col("text").alias("tgt"))
    return u.join(a, ["conv_id", "turn"], "left").select(
        part_key("conv_id", "turn").alias("pair_id"), "src", "tgt")


_OPEN_PAIRS = """open_pairs AS (
  SELECT u.conv_id || ':' || u.turn AS pair_id, u.text AS src, a.text AS tgt
  FROM (SELECT * FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""


@query("drop_null_pairs", sql=f"""
WITH {_OPEN_PAIRS}
SELECT pair_id, CAST(src AS VARCHAR) AS src, CAST(tgt AS VARCHAR) AS tgt
FROM open_pairs WHERE src IS NOT NULL AND tgt IS NOT NULL
""")
def q_drop_null_pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    """User turns left-joined to the next assistant turn (null when there is
    none), then null pairs dropped and both sides cast to text."""
    return C.cast_string(C.drop_null_pairs(_open_pairs(spark, data_dir), ["src", "tgt"]), ["src", "tgt"])


@query("stringify_null", sql=f"""
WITH {_OPEN_PAIRS}
SELECT pair_id, coalesce(CAST(src AS VARCHAR), 'None') AS src, coalesce(CAST(tgt AS VARCHAR), 'None') AS tgt
FROM open_pairs
""")
def q_stringify_null(spark: SparkSession, data_dir: str) -> DataFrame:
    """``str(x)`` semantics: a missing side becomes the text 'None'."""
    return C.stringify(_open_pairs(spark, data_dir), ["src", "tgt"])


_SPLIT_SQL = """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('{seed}:' || CAST(doc_id AS VARCHAR)), doc_id)
                     <= ceil(CAST({ts} AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM documents
"""


@query("split_exact", sql=_SPLIT_SQL.format(seed=SEED, ts=TEST_SIZE))
def q_split_exact(spark: SparkSession, data_dir: str) -> DataFrame:
    docs = load_table(spark, data_dir, "documents").select("doc_id")
    return split_exact(docs, "doc_id", TEST_SIZE, SEED).select("doc_id", "split")


@query("split_exact_null_id", sql=f"""
WITH d AS (SELECT CASE WHEN lang = 'en' THEN NULL ELSE doc_id END AS id FROM documents)
SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || coalesce(CAST(id AS VARCHAR), '')), id)
                     <= ceil(CAST({TEST_SIZE} AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM d
""")
def q_split_exact_null_id(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows without an id (one language here) are split like the others."""
    ids = load_table(spark, data_dir, "documents").select(F.expr("if(lang = 'en', null, doc_id)").alias("id"))
    return split_exact(ids, "id", TEST_SIZE, SEED).select("id", "split")


@query("split_hash", sql=f"""
SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT)
                          < {TEST_SIZE} * 4294967296 THEN 'test' ELSE 'train' END AS split
FROM documents
""")
def q_split_hash(spark: SparkSession, data_dir: str) -> DataFrame:
    docs = load_table(spark, data_dir, "documents").select("doc_id")
    return split_hash(docs, "doc_id", TEST_SIZE, SEED).select("doc_id", "split")


@query("sink_tsv", sql=f"""
WITH {S.doc_lines_cte()}
SELECT line_id, line AS en, lang AS tl FROM lines
""")
def q_sink_tsv(spark: SparkSession, data_dir: str) -> DataFrame:
    """Tab-separated sink with real quoting (lines hold tabs and quotes),
    read back with ``sep='\\t'``."""
    path = scratch_path(spark, "tsv")
    sink_tsv(doc_lines(spark, data_dir).select("line_id", F.col("line").alias("en"), F.col("lang").alias("tl")),
             path, header=True)
    schema = "line_id string, en string, tl string"
    return scan_csv(spark, path, schema, sep="\t", na_values=())
