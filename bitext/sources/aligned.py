"""Two text files whose n-th lines belong together.

Lines are numbered without a sort: rows of a split come in file order, so a
line's number is its place in the split plus the lines of all splits before it
(files by name, then by the split's first byte).  The lines are written once
with their place, since two readings could cut the splits differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize


def numbered_lines(spark: SparkSession, path: str, out: str = "line", header: bool = False) -> DataFrame:
    """``(line_no, out)``: every line of a file, or of a folder's files by name,
    numbered from 0; blank lines count.  ``header`` leaves the first line out."""
    raw = spark.read.text(path).select(F.col("value").alias(out), F.col("_metadata.file_path").alias("_f"),
                                       F.col("_metadata.file_block_start").alias("_b"),
                                       F.monotonically_increasing_id().alias("_m"))
    lines = materialize(raw, "numbered-lines")
    splits = lines.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    start = splits.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
                                       - F.lit(int(header))).alias("_off"))
    numbered = lines.join(start, ["_f", "_b"]).select((F.col("_m") + F.col("_off")).alias("line_no"), out)
    return numbered.where("line_no >= 0")


def zip_files(spark: SparkSession, left: str, right: str, names: tuple[str, str] = ("src", "tgt"),
              header: bool = False) -> DataFrame:
    """``(line_no, *names)``: the n-th line of ``left`` beside the n-th of
    ``right``.  Unequal numbers of lines raise ValueError."""
    a, b = (numbered_lines(spark, p, n, header) for p, n in zip((left, right), names))
    counts = [x.count() for x in (a, b)]
    if counts[0] != counts[1]:
        raise ValueError(f"{left} has {counts[0]} lines and {right} {counts[1]}")
    return a.join(b, "line_no")
