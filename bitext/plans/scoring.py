"""Metric plans over conversation pairs (hypothesis = user turn, reference =
the assistant turn that follows) and the strategy comparison report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import metrics as M
from ..operators.resample import REPLICATES, poisson_cuts, score_intervals
from .encoding import pairs_of
from . import sqlparts as S
from .registry import query

_R6 = "round({x}, 6)"


@query("bleu_counts", sql=f"""
WITH {S.turn_pairs_cte()},
{S.bleu_per_ctes('b', 'pairs', 'pair_id', 'src', 'tgt')},
orders AS (SELECT pair_id, len(h) AS lh, unnest(range(1, 5)) AS n FROM b_tk),
corr AS (SELECT pair_id, n, CAST(sum(least(hc, rc)) AS BIGINT) AS correct FROM b_per GROUP BY pair_id, n)
SELECT o.pair_id, CAST(o.n AS INTEGER) AS n, coalesce(c.correct, 0) AS correct,
       CAST(greatest(o.lh - o.n + 1, 0) AS BIGINT) AS total
FROM orders o LEFT JOIN corr c ON c.pair_id = o.pair_id AND c.n = o.n
""")
def q_bleu_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Clipped n-gram matches and hypothesis n-gram totals per pair and order."""
    return M.bleu_pair_counts(pairs_of(spark, data_dir), "pair_id", "src", "tgt").withColumn(
        "n", F.col("n").cast("int"))


@query("bleu_corpus", sql=f"""
WITH {S.turn_pairs_cte()},
{S.bleu_ctes('b', 'pairs', 'pair_id', 'src', 'tgt')}
SELECT round(bleu, 6) AS bleu, round(bp, 6) AS bp, sys_len, ref_len,
       correct_1, correct_2, correct_3, correct_4, total_1, total_2, total_3, total_4
FROM b
""")
def q_bleu_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    b = M.bleu(pairs_of(spark, data_dir), "pair_id", "src", "tgt")
    return b.withColumn("bleu", F.round("bleu", 6)).withColumn("bp", F.round("bp", 6))


#: The given tables hold no stem or synonym lists; a word's first letters stand
#: in for both, so that SQL can form the same classes.
STEM_CHARS, CLASS_CHARS = 5, 3


@query("meteor_staged", sql=f"""
WITH {S.turn_pairs_cte()},
{S.meteor_staged_ctes('m', 'pairs', 'pair_id', 'src', 'tgt', STEM_CHARS, CLASS_CHARS)}
SELECT pair_id, round(meteor, 6) AS meteor FROM m_sent
""")
def q_meteor_staged(spark: SparkSession, data_dir: str) -> DataFrame:
    """METEOR with all three stages."""
    pairs = pairs_of(spark, data_dir)
    words = pairs.select(F.explode(F.array_union(tokens("src"), tokens("tgt"))).alias("word")).distinct()
    table = lambda n, name: words.select("word", F.substring("word", 1, n).alias(name))
    m = M.meteor_sentences(pairs, "pair_id", "src", "tgt", stems=table(STEM_CHARS, "stem"), synonyms=table(CLASS_CHARS, "class"))
    return m.select("pair_id", F.round("meteor", 6).alias("meteor"))


@query("meteor_exact", sql=f"""
WITH {S.turn_pairs_cte()},
{S.meteor_ctes('m', 'pairs', 'pair_id', 'src', 'tgt')}
SELECT pair_id, round(meteor, 6) AS meteor FROM m_sent
""")
def q_meteor_exact(spark: SparkSession, data_dir: str) -> DataFrame:
    """Sentence METEOR (exact-match stage) per pair."""
    m = M.meteor_sentences(pairs_of(spark, data_dir), "pair_id", "src", "tgt")
    return m.select("pair_id", F.round("meteor", 6).alias("meteor"))


def _interval_sql(name: str, i: int) -> str:
    return f"""SELECT '{name}' AS system, round(max(m{i}) FILTER (WHERE b = 0), 6) AS mean,
       round(quantile_cont(m{i}, 0.025) FILTER (WHERE b > 0), 6) AS low,
       round(quantile_cont(m{i}, 0.5) FILTER (WHERE b > 0), 6) AS median,
       round(quantile_cont(m{i}, 0.975) FILTER (WHERE b > 0), 6) AS high,
       round(avg(CASE WHEN m{i} >= m0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE b > 0), 6) AS p_first FROM reps"""


#: What the second system leaves out of a hypothesis: its first word.
_FIRST_WORD = r"^\S+\s*"
_WEIGHT = " + ".join(f"CAST(d >= {c} AS INTEGER)" for c in poisson_cuts())


@query("score_intervals", sql=f"""
WITH {S.turn_pairs_cte()},
shorter AS (SELECT pair_id, regexp_replace(src, '{_FIRST_WORD}', '') AS src, tgt FROM pairs),
{S.meteor_ctes('a', 'pairs', 'pair_id', 'src', 'tgt')},
{S.meteor_ctes('c', 'shorter', 'pair_id', 'src', 'tgt')},
draws AS (
  SELECT a.meteor AS x0, c.meteor AS x1, b,
         CAST(('0x' || substr(md5(CAST(a.pair_id AS VARCHAR) || ':' || CAST(b AS VARCHAR)), 1, 8)) AS BIGINT) AS d
  FROM a_sent a JOIN c_sent c ON c.pair_id = a.pair_id, (SELECT unnest(range({REPLICATES + 1})) AS b)),
reps AS (
  SELECT b, sum(w * x0) / sum(w) AS m0, sum(w * x1) / sum(w) AS m1
  FROM (SELECT b, x0, x1, CASE WHEN b = 0 THEN 1 ELSE {_WEIGHT} END AS w FROM draws) GROUP BY b)
{_interval_sql('whole', 0)}
UNION ALL
{_interval_sql('shorter', 1)}
""")
def q_score_intervals(spark: SparkSession, data_dir: str) -> DataFrame:
    """Bootstrap intervals of mean METEOR for two systems over the same pairs:
    the whole user turn, and the turn less its first word."""
    pairs = pairs_of(spark, data_dir)
    shorter = pairs.withColumn("src", F.regexp_replace("src", _FIRST_WORD, ""))
    whole = M.meteor_sentences(pairs, "pair_id", "src", "tgt").withColumnRenamed("meteor", "whole")
    less = M.meteor_sentences(shorter, "pair_id", "src", "tgt").withColumnRenamed("meteor", "shorter")
    out = score_intervals(whole.join(less, "pair_id"), "pair_id", ["whole", "shorter"])
    return out.select("system", *[F.round(c, 6).alias(c) for c in ("mean", "low", "median", "high", "p_first")])


@query("rouge_l", sql=f"""
WITH RECURSIVE {S.turn_pairs_cte()},
{S.lcs_ctes('r', 'pairs', 'pair_id', 'src', 'tgt')}
SELECT pair_id, lcs, round(rougeL, 6) AS rougeL FROM r_sent
""")
def q_rouge_l(spark: SparkSession, data_dir: str) -> DataFrame:
    """Sentence ROUGE-L F1 per pair over whole texts (LCS kernel in Arrow batches)."""
    r = M.rouge_l_sentences(pairs_of(spark, data_dir), "pair_id", "src", "tgt")
    return r.select("pair_id", "lcs", F.round("rougeL", 6).alias("rougeL"))
