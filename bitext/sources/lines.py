"""Raw text lines: one sentence per line, stripped, blank lines dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def clean_lines(df: DataFrame, column: str = "value", out: str = "sentence") -> DataFrame:
    """Strip each line and drop the ones left empty (header lines stay data)."""
    s = strip(column)
    return df.select(s.alias(out)).where(F.col(out).isNotNull() & (F.col(out) != ""))


def scan_lines(spark: SparkSession, path: str, out: str = "sentence") -> DataFrame:
    """``[line.strip() for line in f if line.strip()]`` as a distributed scan."""
    return clean_lines(spark.read.text(path), "value", out)
