"""Snapshot versus snapshot: silent restatements of history (J-4, A-8 .. A-10).

A snapshot table holds one row per ``(snapshot, keys...)`` where
``snapshot`` is a dense integer (e.g. a quarter index) and each snapshot
restates the whole history.  Consecutive snapshots are compared with one
``lag`` over ``partitionBy(keys).orderBy(snapshot)``: a single shuffle on
the keys, and each window group holds at most one row per snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_snapshots(snapshots: DataFrame, keys: Sequence[str], snapshot: str = "snapshot",
                   value: str = "value") -> DataFrame:
    """Values that changed between snapshot ``k`` and ``k + 1`` (J-4).

    Only keys present in both snapshots are compared (inner-join
    semantics); a null on either side is ignored; a missing snapshot breaks
    adjacency instead of silently comparing ``k`` with ``k + 2``.  A key that
    a snapshot repeats is compared row by row, as a join would (see
    :func:`repeated_keys`).  Output: ``snapshot`` (the earlier one), keys,
    ``value_before``, ``value_after``.
    """
    before = F.collect_list(value).over(Window.partitionBy(*keys).orderBy(snapshot).rangeBetween(-1, -1))
    return (
        snapshots.select(*keys, snapshot, value, before.alias("_before"))
        .select(*keys, snapshot, value, F.explode(F.filter("_before", lambda x: x != F.col(value))).alias("value_before"))
        .select((F.col(snapshot) - 1).alias(snapshot), *keys, "value_before", F.col(value).alias("value_after"))
    )


def repeated_keys(snapshots: DataFrame, keys: Sequence[str], snapshot: str = "snapshot") -> DataFrame:
    """Keys that a snapshot holds more than once: ``snapshot``, keys, ``n``."""
    return snapshots.groupBy(snapshot, *keys).agg(F.count("*").alias("n")).where("n > 1")


def snapshot_as_of(increments: DataFrame, keys: Sequence[str], period: str, known_at: str, value: str,
                   snapshot: Column) -> DataFrame:
    """The one snapshot ``snapshot`` of :func:`snapshots_from_increments`, without building the others."""
    known = increments.where(F.greatest(F.col(known_at), F.col(period)) <= snapshot)
    return known.groupBy(*keys, period).agg(F.sum(value).alias(value)).withColumn("snapshot", snapshot)


def snapshots_from_increments(increments: DataFrame, keys: Sequence[str], period: str,
                              known_at: str, value: str, last: Column | None = None) -> DataFrame:
    """Materialise "as known at snapshot k" tables from dated increments.

    ``increments`` has one row per (keys, period, known_at) with the amount
    that became known at ``known_at``.  Snapshot ``k`` holds, for every
    (keys, period) with ``period <= k`` and something known by ``k``, the sum
    of increments known by ``k``.  Rows are generated per group as
    ``sequence(first, last)``, so output is (groups x snapshots) with no
    cross join; ``last`` defaults to the latest ``known_at`` overall.
    """
    group = [*keys, period]
    # An amount known before its period counts from the period's own snapshot.
    inc = increments.groupBy(*group, F.greatest(F.col(known_at), F.col(period)).alias("snapshot")) \
        .agg(F.sum(value).alias("_inc"))
    if last is None:
        last = inc.select(F.max("snapshot")).scalar()
    grid = inc.groupBy(*group).agg(F.min("snapshot").alias("_first")).select(
        *group, F.explode(F.sequence(F.col("_first"), last)).alias("snapshot")
    )
    w = Window.partitionBy(*group).orderBy("snapshot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(inc, [*group, "snapshot"], "left").select(
        *group, "snapshot", F.sum("_inc").over(w).alias(value)
    )


def divergence_rate(snapshots: DataFrame, diffs: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """changed / rows of the earlier snapshot * 100, reported at the later one (A-9)."""
    totals = snapshots.groupBy(snapshot).agg(F.count("*").alias("total"))
    changed = diffs.groupBy(snapshot).agg(F.count("*").alias("changed"))
    nxt = snapshots.select(F.col(snapshot).alias("_next")).distinct()
    pairs = totals.join(nxt, F.col("_next") == F.col(snapshot) + 1, "inner")
    return pairs.join(changed, snapshot, "left").select(
        F.col("_next").alias("period"),
        F.coalesce(F.col("changed"), F.lit(0)).alias("changed"),
        "total",
        (F.try_divide(F.coalesce(F.col("changed"), F.lit(0)), F.col("total")) * 100.0).alias("rate_of_divergence"),
    )


def divergence_age(diffs: DataFrame, period: str, snapshot: str = "snapshot") -> DataFrame:
    """Number of divergent values per historical period (A-8); no zero rows."""
    return diffs.groupBy(snapshot, period).agg(F.count("*").alias("divergent"))


def divergence_descriptors(diffs: DataFrame, columns: Sequence[str], snapshot: str = "snapshot") -> DataFrame:
    """Distinct values of descriptive columns seen in each delta (A-10).

    Returned as rows ``(snapshot, descriptor, value)`` -- never a collected
    list -- so a delta of any size stays distributed.
    """
    stacked = None
    for c in columns:
        part = diffs.select(snapshot, F.lit(c).alias("descriptor"), F.col(c).cast("string").alias("value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.distinct()
