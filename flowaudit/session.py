"""Session and checkpoint helpers."""
from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", shuffle: int = 8, app: str = "flowaudit") -> SparkSession:
    """A local session for tests and benches. On a cluster, use the session it gives."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    return (b.config("spark.sql.shuffle.partitions", str(shuffle))
            .config("spark.driver.memory", "12g").getOrCreate())


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is `spark.checkpoint.dir` of the session. Only where none is set
    (local tests) a new temporary folder is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="flowaudit-ckpt-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=eager)


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted when it has run; else they stay until the driver's next collection of garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def shuffles_dropped(df: DataFrame) -> DataFrame:
    """A checkpoint whose shuffle files are deleted once it is written."""
    with dropping_shuffles(df.sparkSession):
        return checkpoint(df.select("*"))


def spread(df: DataFrame) -> DataFrame:
    """Rebalance an input that arrives in fewer splits than there are cores.

    A large table has more splits than cores and passes unchanged; a small file of one row
    group would otherwise be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
