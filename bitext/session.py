"""Session helpers: a local session for tests and benchmarks, and the
checkpoint-directory rule shared by iterative jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """Session for tests and bench runs (local mode, UI off)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName("bitext")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Order: ``spark.checkpoint.dir`` from the session conf (what a cluster
    sets), then a directory already registered on the SparkContext.  Only a
    local-mode session (tests) may fall back to a fresh temp folder; on a
    cluster an unset directory is an error, because a machine-local folder
    does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if conf_dir:
        if current is None:
            sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
    path = tempfile.mkdtemp(prefix="bitext-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df, tag: str = "table"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: cuts lineage (an executor loss recomputes nothing upstream), the
    plan runs once, and the re-read has exact size statistics for AQE."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
