"""Reshaping between long and wide forms (R-1 .. R-9).

Long is the working form; wide appears at the edges and always with an
explicit list of pivot values so Spark never runs a discovery job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "variable",
         value: str = "value") -> DataFrame:
    """Wide to long (R-1)."""
    return df.unpivot(list(ids), list(values), var, value)


def pivot_values(df: DataFrame, index: Sequence[str], column: str, value: str,
                 values: Sequence, agg: str = "first") -> DataFrame:
    """Long to wide with the columns given up front; missing cells are null,
    and columns with no data at all still appear (R-2, R-3)."""
    fn = {"first": F.first, "sum": F.sum, "max": F.max}[agg]
    return df.groupBy(*index).pivot(column, list(values)).agg(fn(value))


def split_variable(df: DataFrame, column: str, first: str, second: str, sep: str = " ") -> DataFrame:
    """Split names carrying two variables, e.g. ``"2020 unique pieces"`` (R-6)."""
    parts = F.split(F.col(column), sep, 2)
    return df.withColumn(first, parts.getItem(0)).withColumn(second, parts.getItem(1)).drop(column)


def interleave(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str],
               value: str, share: str) -> DataFrame:
    """One value and one share column per pivot value, side by side (R-7)."""
    aggs = []
    for v in values:
        aggs.append(F.sum(F.when(F.col(column) == v, F.col(value))).alias(str(v)))
        aggs.append(F.sum(F.when(F.col(column) == v, F.col(share))).alias(f"{v}_pct"))
    return df.groupBy(*index).agg(*aggs)


def side_by_side(frames: dict[str, DataFrame], key: Sequence[str], value: str) -> DataFrame:
    """Columns of several labelled series aligned on a key (R-9, J-6).

    Full outer joins, so a key missing from one series gives a null there.
    """
    out = None
    for label, frame in frames.items():
        part = frame.select(*key, F.col(value).alias(label))
        out = part if out is None else out.join(part, list(key), "full")
    return out
