"""Enrichment of per-key counts: denominators, hierarchy, summaries, repairs.

(J-1, J-2, J-3, J-7, J-8, A-16, A-17, P-13, P-14, P-15, P-16, F-20)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.operators.joins import dim_join


def per_capita(facts: DataFrame, population: DataFrame, keys: Sequence[str],
               value: str = "reports", denominator: str = "population",
               out: str = "reports_per_capita") -> DataFrame:
    """Inner join on the composite key, then ``value / denominator`` (J-1, F-20).

    Keys without a denominator drop out here; :func:`without_denominator`
    reports them.
    """
    joined = facts.join(population, list(keys), "inner")
    return joined.withColumn(out, F.try_divide(F.col(value).cast("double"), F.col(denominator).cast("double")))


def without_denominator(facts: DataFrame, population: DataFrame, key: str,
                        by: Sequence[str], value: str) -> DataFrame:
    """Keys with facts but no denominator and their totals per ``by`` (J-8)."""
    missing = facts.join(population.select(key).distinct(), key, "left_anti")
    return missing.groupBy(*by).agg(
        F.sum(value).alias(value), F.count_distinct(key).alias("keys_without")
    )


def keys_without_denominator(facts: DataFrame, population: DataFrame, keys: Sequence[str],
                             by: Sequence[str], value: str) -> DataFrame:
    """Each key with facts but no denominator, by name, with its total per ``by`` (J-8)."""
    missing = facts.join(population.select(*keys).distinct(), list(keys), "left_anti")
    return missing.groupBy(*by, *keys).agg(F.sum(value).alias(value))


def member_flag(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Boolean ``flag``: does ``key`` appear in ``members`` (J-7)?"""
    m = members.select(F.col(key).alias("_m")).distinct().withColumn("_in", F.lit(True))
    return df.join(m, df[key] == m["_m"], "left").withColumn(
        flag, F.coalesce(F.col("_in"), F.lit(False))
    ).drop("_m", "_in")


def resolve_parent(child_parent: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Two-level hierarchy: each child's parent and grandparent (J-3).

    A self left join; a child whose parent has no parent keeps the parent
    as its top level (``coalesce``).
    """
    up = child_parent.select(F.col(child).alias("_p"), F.col(parent).alias("_gp"))
    return child_parent.join(up, child_parent[parent] == up["_p"], "left").select(
        F.col(child), F.col(parent), F.coalesce(F.col("_gp"), F.col(parent)).alias("top")
    )


def summary_rows(df: DataFrame, member: Column, by: Sequence[str], sums: Sequence[str],
                 constants: dict[str, object], ratios: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Append one synthetic row per group summing the members (A-17, U-1).

    ``constants`` fill identifying columns (e.g. a code and a name);
    ``ratios`` are recomputed from the sums, not summed.
    """
    agg = df.where(member).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    for name, value in constants.items():
        agg = agg.withColumn(name, F.lit(value))
    for name, (num, den) in (ratios or {}).items():
        agg = agg.withColumn(name, F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")))
    return df.unionByName(agg, allowMissingColumns=True)


def apply_overrides(df: DataFrame, overrides: DataFrame, keys: Sequence[str], column: str,
                    bounded: bool = False) -> DataFrame:
    """Replace cells named in ``overrides(keys..., new_value)`` (P-13).

    A null ``new_value`` knocks the cell out.  Many overrides become one
    join instead of a chain of ``when`` expressions.
    """
    o = overrides.withColumn("_hit", F.lit(True))
    joined = dim_join(df, o, list(keys), "left", bounded=bounded)
    return joined.withColumn(
        column, F.when(F.col("_hit"), F.col("new_value")).otherwise(F.col(column))
    ).drop("new_value", "_hit")


def repair_keys(df: DataFrame, repairs: DataFrame, key: str, by: str,
                bad_values: Sequence[str] = ("-99",), bounded: bool = False) -> DataFrame:
    """Fill missing/placeholder codes from a repair map ``(by, fixed)`` (P-14)."""
    fixed = dim_join(df, repairs, by, "left", bounded=bounded)
    cleaned = F.col(key)
    for bad in bad_values:
        cleaned = F.nullif(cleaned, F.lit(bad))
    return fixed.withColumn(key, F.coalesce(cleaned, F.col("fixed"))).drop("fixed")


def assign_buckets(df: DataFrame, taxonomy: DataFrame, label: str, bounded: bool = False) -> DataFrame:
    """Attach ``(taxonomy, bucket)`` for every taxonomy listing ``label`` (P-16).

    ``taxonomy(taxonomy, bucket, member)``; a label may fall in one bucket
    per taxonomy, so rows multiply by the number of taxonomies at most.
    """
    return dim_join(df, taxonomy, df[label] == taxonomy["member"], "inner", bounded=bounded).drop("member")
