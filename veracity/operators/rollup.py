"""Annualising, ownership rollup, computed columns (A-1 .. A-7, J-9, J-10).

All of these work on the long ``observation`` table so that one shuffle by
``(entity, period)`` serves every entity at once instead of one plan per
entity.  Aggregations are hash aggregates with map-side partial
aggregation, so a hot entity costs one pre-aggregated row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions.periods import end_month, make_period, start_month
from veracity.operators.joins import dim_join

OBS_KEYS = ("entity", "observer")


def sum_null_if_empty(c: str | Column) -> Column:
    """Group sum that stays null when every input is null (A-2)."""
    return F.sum(c)


def sum_zero_if_empty(c: str | Column) -> Column:
    """Group sum that treats an all-null group as 0 (A-1)."""
    return F.coalesce(F.sum(c), F.lit(0))


def annualize(obs: DataFrame, keys: Sequence[str] = OBS_KEYS) -> DataFrame:
    """Sum each metric per calendar year, keeping a year only when the
    entity's rows for it reach from January to December (A-6).

    The coverage test looks at rows, not at which metric is non-null: the
    rows of one (keys, year) share one verdict across metrics.  Output is
    again an observation table with yearly periods.
    """
    p = F.col("period")
    per_metric = obs.groupBy(*keys, p.getField("year").alias("year"), "metric").agg(
        F.sum("value").alias("value"),
        F.min(start_month(p)).alias("_first_month"),
        F.max(end_month(p)).alias("_last_month"),
    )
    w = Window.partitionBy(*keys, "year")
    covered = (F.min("_first_month").over(w) == 1) & (F.max("_last_month").over(w) == 12)
    return per_metric.select(
        *keys, make_period("year", "Y", 1).alias("period"), "metric", "value",
        F.lit(False).alias("redundant"), covered.alias("_covered"),
    ).where("_covered").drop("_covered")


def quarter_mask(period: str | Column) -> Column:
    """Bit i-1 set for every quarter i of its year that ``period`` covers (F-6)."""
    p = F.col(period) if isinstance(period, str) else period
    first_q = F.floor((start_month(p) - 1) / 3).cast("int")
    n_q = (F.floor((end_month(p) - 1) / 3) - first_q + 1).cast("int")
    return ((F.pow(F.lit(2), n_q) - 1) * F.pow(F.lit(2), first_q)).cast("int")


def annualize_strict(obs: DataFrame, keys: Sequence[str] = OBS_KEYS) -> DataFrame:
    """Per metric, a year's sum is kept only when non-null values cover all
    four quarters; otherwise the year's value is null (A-7).

    Coverage is a 4-bit mask OR-ed in the same aggregate as the sum, so the
    test costs no extra pass, explode or join.
    """
    p = F.col("period")
    return (
        obs.groupBy(*keys, p.getField("year").alias("year"), "metric")
        .agg(
            F.sum("value").alias("_sum"),
            F.bit_or(F.when(F.col("value").isNotNull(), quarter_mask(p))).alias("_mask"),
        )
        .select(
            *keys,
            make_period("year", "Y", 1).alias("period"),
            "metric",
            F.when(F.col("_mask") == 15, F.col("_sum")).alias("value"),
            F.lit(False).alias("redundant"),
        )
    )


def rollup(obs: DataFrame, ownership: DataFrame, keys: Sequence[str] = ("observer", "period", "metric"),
           keep_members: bool = False, exclude_owners: Sequence[str] = (),
           bounded_ownership: bool = False) -> DataFrame:
    """Fold members into their owners (J-10, A-2).

    ``ownership(owner, member)``.  A member's rows move to its owner, the
    owner's own rows stay, and values are summed (null only if all null).
    ``keep_members=True`` also keeps each member's own rows, as the wide
    receiver table does with ``drop_brands=False``.  Owners listed in
    ``exclude_owners`` keep their members separate.
    """
    own = ownership.select(F.col("member").alias("_member"), F.col("owner").alias("_owner"))
    if exclude_owners:
        own = own.where(~F.col("_owner").isin(*exclude_owners))
    joined = dim_join(obs, own, obs["entity"] == own["_member"], "left", bounded=bounded_ownership)
    rolled = joined.groupBy(F.coalesce(F.col("_owner"), F.col("entity")).alias("entity"), *keys) \
        .agg(F.sum("value").alias("value"))
    if not keep_members:
        return rolled
    members = joined.where(F.col("_owner").isNotNull()).select("entity", *keys, "value")
    return rolled.unionByName(members)


def add_fill_zero(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left.add(right, fill_value=0)``: union of rows, null only when both
    sides are null or missing (A-4)."""
    return left.unionByName(right, allowMissingColumns=True).groupBy(*keys).agg(F.sum("value").alias("value"))


def row_sum(*cols: str | Column, empty_null: bool = True) -> Column:
    """Null-skipping sum across columns of one row (A-5)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    total = sum((F.coalesce(c, F.lit(0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0)))
    if not empty_null:
        return total
    any_value = F.greatest(*[c.isNotNull().cast("int") for c in cs]) if len(cs) > 1 else cs[0].isNotNull().cast("int")
    return F.when(any_value == 1, total)


def computed_columns(obs: DataFrame, rules: DataFrame,
                     keys: Sequence[str] = ("entity", "observer", "period"),
                     bounded_rules: bool = False) -> DataFrame:
    """Derive target metrics from declared source metrics (A-3).

    ``rules(entity, kind, target, source)`` with ``kind`` in ``sums`` /
    ``products``.  Each (keys, target) is the sum or product of its
    non-null sources, null when all are null.  A ``sums`` target that also
    exists as a published metric is added to it with fill 0 (A-4).
    Rules without an ``entity`` column apply to every entity.  Returns the
    input observations with computed targets added/replaced.
    """
    per_entity = "entity" in rules.columns
    r = rules.select(
        *([F.col("entity").alias("_r_entity")] if per_entity else []),
        "kind", "target", F.col("source").alias("_source"),
    )
    cond = obs["metric"] == r["_source"]
    if per_entity:
        cond = cond & (obs["entity"] == r["_r_entity"])
    # Rules are few; the join is keyed on (entity, metric) or on the metric.
    joined = dim_join(obs, r, cond, "inner", bounded=bounded_rules)
    computed = joined.groupBy(*keys, "kind", "target").agg(
        F.sum("value").alias("_s"), F.product("value").alias("_p")
    ).select(
        *keys,
        F.col("target").alias("metric"),
        F.when(F.col("kind") == "sums", F.col("_s")).otherwise(F.col("_p")).alias("value"),
        F.col("kind"),
    )
    base = obs.select(*keys, "metric", "value", F.lit(None).cast("string").alias("kind"))
    # Published target + computed sum -> add with fill 0; products replace.
    return (
        base.unionByName(computed)
        .groupBy(*keys, "metric")
        .agg(
            F.when(
                F.max(F.col("kind") == "products"),
                F.max(F.when(F.col("kind") == "products", F.col("value"))),
            ).otherwise(F.sum("value")).alias("value")
        )
    )


def calendar_spine(entities: DataFrame, years_from: DataFrame, year_col: str = "year") -> DataFrame:
    """Every entity crossed with the contiguous year range of ``years_from`` (J-9).

    Built as ``explode(sequence(min, max))`` per entity with the bounds as
    scalar subqueries: no cross join, and the output grows with
    entities x years only.
    """
    bounds = years_from.select(F.struct(F.min(year_col).alias("lo"), F.max(year_col).alias("hi"))).scalar()
    # One subquery reference (as a column), read twice below.
    with_bounds = entities.select("*", bounds.alias("_bounds"))
    return with_bounds.select(*entities.columns,
                              F.explode(F.sequence(F.col("_bounds.lo"), F.col("_bounds.hi"))).alias(year_col))
