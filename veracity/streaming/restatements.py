"""Snapshot restatements found as snapshot files land (J-4, incrementally).

Each published snapshot restates the whole history.  A Structured
Streaming file source picks up new snapshot files; for every micro-batch
the new rows are compared with the same and neighbouring snapshots already
in the history table, using the same :func:`diff_snapshots` operator as the
batch audit.  History is stored partitioned by snapshot and batch, so a batch
reads back only the snapshots adjacent to the new ones (partition pruning),
never the whole history.

Writes are idempotent per batch: diffs and history are partitioned by
``batch_id`` and written with dynamic partition overwrite, so a retried batch
replaces its own output and nothing else.  A snapshot may come in several
files and batches (each of its keys once), and snapshots may arrive out of
order; a pair is emitted by whichever batch brings its second row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.operators.revisions import diff_snapshots
from veracity.sources.csv import string_schema


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def restatement_monitor(spark: SparkSession, source: str, columns: Sequence[str], types: dict[str, str],
                        snapshot_pattern: str, keys: Sequence[str], value: str,
                        history_path: str, diffs_path: str, checkpoint_location: str,
                        files_per_batch: int | None = None, available_now: bool = True):
    """Start the monitor; returns the ``StreamingQuery``.

    ``source`` is a folder (or glob) receiving one CSV file per snapshot;
    ``snapshot_pattern`` extracts (year, quarter) from the file path.
    """
    reader = spark.readStream.schema(string_schema(columns)).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.csv(source).withColumn("_path", F.col("_metadata.file_path"))
    year = F.regexp_extract("_path", snapshot_pattern, 1).cast("int")
    quarter = F.regexp_extract("_path", snapshot_pattern, 2).cast("int")
    typed = raw.select(
        *[F.col(c).try_cast(types.get(c, "string")).alias(c) for c in columns],
        (year * 4 + quarter - 1).alias("snapshot"),
    )

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by the diff and by the history write
        new_snaps = batch.select("snapshot").distinct()
        candidates = batch
        if _exists(spark, history_path):
            hist = spark.read.parquet(history_path).where(F.col("batch_id") != batch_id)  # not its own, if retried
            near = new_snaps.select(F.explode(F.sequence(F.col("snapshot") - 1, F.col("snapshot") + 1)).alias("snapshot"))
            neighbours = hist.join(near.distinct(), "snapshot", "left_semi")
            candidates = batch.unionByName(neighbours.select(*batch.columns))
        diffs = diff_snapshots(candidates, keys, "snapshot", value)
        # Keep pairs with at least one new row; pairs of two stored rows were emitted before.
        # A diff is keyed by its earlier snapshot s; it is fresh when the key's row of s or s + 1 is new.
        names = ["snapshot", *keys]
        fresh_keys = batch.select(
            F.explode(F.array(F.col("snapshot"), F.col("snapshot") - 1)).alias("f_snapshot"),
            *[F.col(k).alias(f"f_{k}") for k in keys]).distinct()
        fresh = diffs.join(fresh_keys, reduce(and_, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in names]), "left_semi")
        (fresh.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(diffs_path))
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot", "batch_id").parquet(history_path))
        batch.unpersist()

    writer = typed.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_restatements(spark: SparkSession, diffs_path: str, keys: Sequence[str], types: dict[str, str],
                      value: str) -> DataFrame:
    """The monitor's output with its declared schema (readable even while empty)."""
    cols = ["snapshot int", *[f"`{k}` {types.get(k, 'string')}" for k in keys],
            f"value_before {types.get(value, 'string')}", f"value_after {types.get(value, 'string')}", "batch_id int"]
    schema = ", ".join(cols)
    if not _exists(spark, diffs_path):
        return spark.createDataFrame([], schema).drop("batch_id")
    return spark.read.schema(schema).parquet(diffs_path).drop("batch_id")
