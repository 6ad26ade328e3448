"""Join helpers that keep broadcast decisions honest.

A dimension is broadcast explicitly only when its size is bounded by
construction (e.g. the 25 nations).  Everything else joins without a hint:
with AQE on, Spark re-plans a shuffle join into a broadcast join at run
time only when the *measured* shuffle output is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` -- a size check with the
sort-merge join as the way beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dim_join(fact: DataFrame, dim: DataFrame, on: str | Sequence[str] | Column,
             how: str = "left", bounded: bool = False) -> DataFrame:
    """Join a fact to a dimension; ``bounded=True`` asserts a fixed small size."""
    right = F.broadcast(dim) if bounded else dim
    return fact.join(right, on, how)


def scalar(df: DataFrame, expr: Column) -> Column:
    """A one-value aggregate of ``df`` usable as a column elsewhere.

    Compiles to a scalar subquery (computed once), instead of a cross join
    with a one-row frame or a driver round trip.
    """
    return df.select(expr).scalar()


def unique_scalar(df: DataFrame, column: str) -> Column:
    """The value of ``column`` in the only row of ``df`` as a scalar subquery (P-17).

    No row or a second row fails the job: a lookup must not choose.
    """
    n = F.count(F.lit(1))
    told = F.concat(F.lit(f"expected one row to look up {column}, found "), n.cast("string"))
    return df.select(F.when(n == 1, F.first(column)).otherwise(F.raise_error(told).cast(df.schema[column].dataType))).scalar()
