"""The canonical long table and small helpers around it.

``observation(entity, observer, period, metric, value, redundant)``: one
row per published number.  Wide tables only appear at the edges (``pivot``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.periods import make_period

OBSERVATION_COLUMNS = ("entity", "observer", "period", "metric", "value", "redundant")


def observations(df: DataFrame, entity: str | Column, observer: str | Column,
                 period: str | Column, metrics: Sequence[str],
                 redundant: str | Column | None = None) -> DataFrame:
    """Melt the wide metric columns of ``df`` into canonical observations (R-1)."""
    def c(x):
        return F.col(x) if isinstance(x, str) and x in df.columns else (x if isinstance(x, Column) else F.lit(x))

    base = df.select(
        c(entity).alias("entity"),
        c(observer).alias("observer"),
        c(period).alias("period"),
        (c(redundant) if redundant is not None else F.lit(False)).cast("boolean").alias("redundant"),
        *[F.col(m).cast("double").alias(m) for m in metrics],
    )
    return base.unpivot(
        ["entity", "observer", "period", "redundant"], list(metrics), "metric", "value"
    ).select(*OBSERVATION_COLUMNS)


def drop_redundant(obs: DataFrame, include_redundant: bool = False) -> DataFrame:
    """Drop rows flagged redundant unless asked to keep them (P-12)."""
    return obs if include_redundant else obs.where(~F.coalesce(F.col("redundant"), F.lit(False)))


def conform_columns(df: DataFrame, columns: Iterable[str], dtype: str = "double") -> DataFrame:
    """Keep ``columns`` in order, adding missing ones as typed nulls (P-2)."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast(dtype).alias(c) for c in columns])


def with_year_period(df: DataFrame, year_col: str = "year") -> DataFrame:
    """Attach a calendar-year period struct built from an integer year."""
    return df.withColumn("period", make_period(year_col, "Y", 1))


def wide(obs: DataFrame, index: Sequence[str], metrics: Sequence[str],
         metric_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Long to wide with the metric list given, so empty columns survive (R-2, R-3).

    Passing the values avoids the extra job Spark runs to discover them.
    """
    return (
        obs.groupBy(*index)
        .pivot(metric_col, list(metrics))
        .agg(F.sum(value_col))
    )
