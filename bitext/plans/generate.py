"""Synthetic-data plans: round-trip gate, gate statistics, augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import clean_pairs, turn_pairs
from ..operators.synth import THRESHOLD, gate_blank
from ..operators.similarity import with_token_cosine
from ..sources.tables import load_table
from . import sqlparts as S
from .registry import query


def scored_pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    """Cleaned conversation pairs with the token cosine of source and target."""
    pairs = clean_pairs(turn_pairs(load_table(spark, data_dir, "conversations")))
    return with_token_cosine(pairs, "pair_id", "src", "tgt")


@query("round_trip_gate", sql=f"""
WITH {S.turn_pairs_cte()},
{S.token_cosine_cte('sims', 'pairs', 'src', 'tgt')}
SELECT p.pair_id, p.src AS sentence,
       CASE WHEN s.similarity >= {THRESHOLD} THEN p.tgt ELSE '' END AS synthetic,
       round(s.similarity, 6) AS similarity
FROM pairs p JOIN sims s ON p.pair_id = s.pair_id
""")
def round_trip_gate(spark: SparkSession, data_dir: str) -> DataFrame:
    """Flagship: pair user turn t with assistant turn t+1, clean, score the
    pair by token cosine, blank targets below 0.70."""
    scored = gate_blank(scored_pairs(spark, data_dir), "tgt", "similarity", THRESHOLD)
    return scored.select("pair_id", F.col("src").alias("sentence"),
                         F.col("tgt").alias("synthetic"),
                         F.round("similarity", 6).alias("similarity"))
