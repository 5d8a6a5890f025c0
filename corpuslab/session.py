"""Session, table loading and staging helpers.

Nothing here holds a global session: every operator takes DataFrames and returns DataFrames.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(app: str = "corpuslab", cpus: str | int | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster session comes from spark-submit."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    shuffle_partitions = shuffle_partitions or os.environ.get("CORPUSLAB_SHUFFLE_PARTITIONS")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSLAB_DRIVER_MEMORY", "16g"))
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must exist (a machine-local folder would lose staged tables with the
    executor). Only a local-mode session without the setting gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before staging tables")
        configured = tempfile.mkdtemp(prefix="corpuslab-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    Cuts lineage without computing the input twice (``Dataset.checkpoint`` recomputes an
    unpersisted plan to write it) and survives executor loss, unlike a cache.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an input that arrives in fewer splits than there are cores (a small file with
    one row group). A large input already has one split per row group and is left as it is, so
    this never adds a shuffle at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
