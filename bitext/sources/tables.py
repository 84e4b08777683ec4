"""Parquet tables of a data directory (one ``<name>.parquet`` per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def load_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; column pruning and filter pushdown are Catalyst's,
    the size of a split is the session's (``spark.sql.files.*``)."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, data_dir: str, name: str, bytes_per_trigger: int | None = None) -> DataFrame:
    """The table as a file stream, whether it is one file or a folder of files
    (a stream reads folders only, so one file is picked out of its folder).
    ``bytes_per_trigger`` bounds a micro-batch (one file at least)."""
    table = load_table(spark, data_dir, name)
    folder, one = data_dir.rstrip("/"), f"{name}.parquet"
    reader = spark.readStream.schema(table.schema)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(bytes_per_trigger))
    if [f.rsplit("/", 1)[-1] for f in table.inputFiles()] == [one]:
        return reader.option("pathGlobFilter", one).parquet(folder)
    return reader.parquet(f"{folder}/{one}")
