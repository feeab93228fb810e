"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "rasterledger", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    A folder of our own is created only on a local master, where driver and
    tasks share one disk; on a cluster the setting has to be given.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return named


def pin(df: DataFrame) -> DataFrame:
    """Materialise a frame in the checkpoint folder and cut its lineage."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fill_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan that has fewer partitions than cores, before heavy work per row.

    Large inputs have partitions enough and pass through without a shuffle. Meant
    for plain scans: for other plans, asking for the number runs their shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
