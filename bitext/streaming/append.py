"""A stream into the append sink, with the progress of its epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import running_progress
from ..sources.append import FORMAT, AppendSource, Ledger, appended_epochs


def append_stream(rows: DataFrame, path: str, checkpoint_path: str, sep: str = "\t", header: bool = False,
                  timeout_s: float | None = None):
    """Append what ``rows`` (a streaming DataFrame) holds now, each row once
    however often this is killed and called again; returns the finished query."""
    rows.sparkSession.dataSource.register(AppendSource)
    Ledger(path).open()
    q = (rows.writeStream.format(FORMAT).outputMode("append").option("path", path).option("sep", sep)
         .option("header", str(header).lower()).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    if not q.awaitTermination(timeout_s) and timeout_s is not None:
        q.stop()
        raise TimeoutError(f"the stream was not finished after {timeout_s} s; a rerun resumes it")
    return q


def append_progress(spark: SparkSession, path: str, total_rows: int | None = None) -> DataFrame:
    """Rows done after each epoch, rows a second and, with ``total_rows``, the
    time left (columns of ``running_progress``)."""
    log = appended_epochs(spark, path).select(F.lit(path).alias("job"), F.col("finished_at").alias("ts"),
                                              "n_rows", F.lit(total_rows).cast("long").alias("total"))
    return running_progress(log, "job", "ts", rows="n_rows", total=None if total_rows is None else "total")
