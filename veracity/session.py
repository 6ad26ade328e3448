"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

# Defaults for a local session; on a cluster the submitting job's own
# configuration wins because ``getOrCreate`` reuses the active session.
_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Recommended settings for a large cluster (about 100 TB of input, ~1000
# executors).  ``get_spark`` never overrides an active session; pass these to
# spark-submit.  Sizing rationale: start with many shuffle partitions and let
# AQE coalesce them to ~256 MB each (no partition has to fit more than that
# in executor memory, so aggregates and sorts spill rarely); split Parquet
# input at 256 MB; split skewed join partitions above 5x the median.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    # spark.checkpoint.dir: a shared folder (HDFS / object store) named by the cluster.
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "veracity") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_LOCAL_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("VERACITY_DRIVER_MEMORY", "16g"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str = "/tmp/veracity-checkpoints") -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object store) folder there; only when the
    setting is absent in a local session, as in tests, do we fall back to a
    local path.  Without it a cluster session raises: its executors share no
    local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(fallback)
        current = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder.

    Used for small aggregates that several branches of one plan read: the
    expensive lineage runs once, the files survive executor loss (unlike
    cached blocks or a local checkpoint), and the optimizer gets real file
    sizes for its join decisions.  One write job, unlike an eager
    ``Dataset.checkpoint`` that computes its input twice.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/veracity-{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
