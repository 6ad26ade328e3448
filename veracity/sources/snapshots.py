"""A store of snapshots: one partition per snapshot, buckets by key (S-8, J-4).

Reading one snapshot lists one partition.  Two snapshots are compared bucket
by bucket: both are stored by the hash of the key and sorted, so no row
moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_store(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int,
                snapshot: str = "snapshot") -> None:
    """Write ``df`` as ``table``, its files under the shared folder ``path``."""
    (df.repartition(buckets, *keys).write.format("parquet").mode("overwrite").option("path", path)
     .partitionBy(snapshot).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))


def read_snapshot(spark: SparkSession, table: str, which: int, snapshot: str = "snapshot") -> DataFrame:
    """One snapshot; the other partitions are not read."""
    return spark.table(table).where(F.col(snapshot) == which)


def diff_pair(spark: SparkSession, table: str, keys: Sequence[str], value: str, which: int,
              snapshot: str = "snapshot") -> DataFrame:
    """Values that changed between snapshots ``which`` and ``which + 1``; as ``diff_snapshots``, for one pair."""
    before = read_snapshot(spark, table, which, snapshot).select(*keys, F.col(value).alias("value_before"))
    after = read_snapshot(spark, table, which + 1, snapshot).select(*keys, F.col(value).alias("value_after"))
    return before.join(after, list(keys)).where("value_before != value_after").select(
        F.lit(which).alias(snapshot), *keys, "value_before", "value_after")
