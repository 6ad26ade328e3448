"""Shares, ranks, growth, fits and distributions (A-13 .. A-22, W-1 .. W-7, F-21).

Windows are always partitioned by a group key (year, entity...) and run on
aggregated rows.  Global quantities (a grand total, a global min/max) are
scalar subqueries, never an unpartitioned window that would pull every row
into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from veracity.session import cut_lineage


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Shares and ranks


def share_of_group(value: str | Column, by: Sequence[str]) -> Column:
    """``value / sum(value) over group * 100`` (A-15); null on a zero total."""
    v = _col(value).cast("double")
    return F.try_divide(v, F.sum(v).over(Window.partitionBy(*by))) * 100.0


def group_total(value: str | Column, by: Sequence[str]) -> Column:
    """The group's total on every row (W-5)."""
    return F.sum(_col(value)).over(Window.partitionBy(*by))


def running_share(value: str | Column, by: Sequence[str], order: Sequence[Column]) -> Column:
    """Cumulative share within the group in the given order (W-4)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = _col(value).cast("double")
    return F.try_divide(F.sum(v).over(w), F.sum(v).over(Window.partitionBy(*by))) * 100.0


def rank_within(by: Sequence[str], order: Sequence[Column]) -> Column:
    """1-based dense position; callers add a key to ``order`` to break ties (W-1)."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def top_shares_with_others(df: DataFrame, label: str, value: str, by: Sequence[str],
                           threshold: float, others: str = "Others") -> DataFrame:
    """Labels whose share exceeds ``threshold`` plus a residual row (A-18).

    The residual is ``100 - sum(kept shares)`` per group.
    """
    shares = df.select(*by, label, share_of_group(value, by).alias("share"))
    kept = shares.where(F.col("share") > threshold)
    residual = kept.groupBy(*by).agg((100.0 - F.sum("share")).alias("share")) \
        .select(*by, F.lit(others).alias(label), "share")
    return kept.unionByName(residual)


def top_shares_wide(df: DataFrame, label: str, value: str, by: Sequence[str], threshold: float,
                    labels: Sequence[str], others: str = "Others") -> DataFrame:
    """:func:`top_shares_with_others` with one column per label, 0 where a group keeps none (A-18).

    ``labels`` names the columns; a kept label beyond them fails the job.
    """
    long = top_shares_with_others(df, label, value, by, threshold, others)
    names = [*labels, others]
    known = F.when(F.col(label).isin(names), F.col(label)).otherwise(
        F.raise_error(F.concat(F.lit("no column for "), F.coalesce(F.col(label), F.lit("null")))).cast("string"))
    return long.withColumn(label, known).groupBy(*by).pivot(label, names).agg(F.sum("share")).fillna(0.0, names)


# ---------------------------------------------------------------------------
# Growth


def percent_of_base(value: str | Column, by: Sequence[str], order_col: str, base) -> Column:
    """``value`` as % of its value at ``order_col == base`` in the same group (W-2, P-17).

    A group with two rows at the base fails the job.
    """
    v, w = _col(value).cast("double"), Window.partitionBy(*by)
    at_base = F.col(order_col) == base
    base_value = F.when(F.count_if(at_base).over(w) > 1, F.raise_error(F.lit(f"several rows at {order_col} = {base}")).cast("double")) \
        .otherwise(F.max(F.when(at_base, v)).over(w))
    return F.try_divide(v, base_value) * 100.0


def zscore(value: str | Column, by: Sequence[str]) -> Column:
    """``(x - mean) / stddev_samp`` within the group (W-6)."""
    w = Window.partitionBy(*by)
    v = _col(value).cast("double")
    return F.try_divide(v - F.avg(v).over(w), F.stddev_samp(v).over(w))


# ---------------------------------------------------------------------------
# Fits


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group: slope, intercept (A-19)."""
    return df.groupBy(*by).agg(
        F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
        F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
        F.regr_count(F.col(y).cast("double"), F.col(x).cast("double")).alias("n"),
    )


def piecewise_fit(df: DataFrame, by: Sequence[str], x: str, y: str, breakpoint) -> DataFrame:
    """Two lines split at ``breakpoint`` (``x < bp`` / ``x >= bp``) (A-20)."""
    seg = F.when(F.col(x) < breakpoint, F.lit("before")).otherwise(F.lit("after"))
    return linear_fit(df.withColumn("segment", seg), [*by, "segment"], x, y)


def exp_fit(df: DataFrame, by: Sequence[str], x: str, y: str, weighted: bool = False) -> DataFrame:
    """Fit ``ln y = a + b x`` (A-21); ``weighted`` uses weights ``y`` on the
    squared residuals (numpy's ``w=sqrt(y)``), solved in closed form."""
    z = F.ln(F.col(y).cast("double"))
    xd = F.col(x).cast("double")
    if not weighted:
        return df.where(F.col(y) > 0).groupBy(*by).agg(
            F.regr_slope(z, xd).alias("rate"), F.regr_intercept(z, xd).alias("log_scale"),
        )
    w = F.col(y).cast("double")
    sums = df.where(F.col(y) > 0).groupBy(*by).agg(
        F.sum(w).alias("sw"), F.sum(w * xd).alias("swx"), F.sum(w * z).alias("swz"),
        F.sum(w * xd * xd).alias("swxx"), F.sum(w * xd * z).alias("swxz"),
    )
    det = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
    rate = F.try_divide(F.col("sw") * F.col("swxz") - F.col("swx") * F.col("swz"), det)
    return sums.select(
        *by,
        rate.alias("rate"),
        F.try_divide(F.col("swz") - rate * F.col("swx"), F.col("sw")).alias("log_scale"),
    )


def mean_squared_error(actual: str | Column, fitted: str | Column) -> Column:
    """``avg((y - fit)^2)`` as an aggregate (A-13)."""
    return F.avg(F.pow(_col(actual).cast("double") - _col(fitted), 2))


def mse_factors(fitted: DataFrame, by: Sequence[str], actual: str, models: Sequence[str], baseline: str) -> DataFrame:
    """``by, model, mse, factor``: each fit's error, and as a multiple of the baseline fit's (A-13).

    ``models`` are the columns of fitted values; one pass for all of them.
    """
    errors = fitted.groupBy(*by).agg(*[mean_squared_error(actual, m).alias(m) for m in models])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("mse"),
                                        F.try_divide(F.col(m), F.col(baseline)).alias("factor")) for m in models]))
    return errors.select(*by, each.alias("e")).select(*by, "e.*")


# ---------------------------------------------------------------------------
# Distributions


# Equal-width buckets per target interval and round, and how many distinct
# values an interval may hold before its values are ranked.
QUANTILE_BUCKETS = 1 << 14
RANKED_VALUES = 1 << 12


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    buckets: int = QUANTILE_BUCKETS, ranked: int = RANKED_VALUES) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/R type 7) per group.

    Distributed selection, no group gathered into one task:

    1. rows -> ``(group, value, count)`` (shuffled by group *and* value, so a
       hot group spreads over all tasks), written once;
    2. every order statistic ``floor/ceil(p * (n - 1))`` starts with its
       group's whole range of values; in rounds, for all groups at once, each
       target interval is cut into ``buckets`` equal parts and shrinks to the
       least and greatest value of the part that holds the statistic;
    3. once no interval holds more than ``ranked`` distinct values, the values
       of the intervals are ranked.

    However the values cluster, the least and the greatest value of an
    interval part in every round.  A null group is a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    by = list(by)
    keys = by or ["_g"]  # a stored constant: one group needs no scalar subquery
    held = cut_lineage(counts if by else counts.withColumn("_g", F.lit(0)), "value-counts")
    targets, left = _targets(held, keys, value, probs), None
    while True:  # ends for values that no double tells apart, too
        found = Observation()
        refined = _refine(held, targets, keys, value, max(2, buckets)).observe(found, F.max("_d").alias("most"))
        targets, before, left = cut_lineage(refined, "quantile-targets"), left, found.get["most"] or 0
        if left <= ranked or left == before:
            break
    picked = _pick(held, targets, keys, value)
    aggs = []
    for i in range(len(probs)):
        lo = F.max(F.when((F.col("_i") == i) & (F.col("_side") == 0), F.col(value)))
        hi = F.max(F.when((F.col("_i") == i) & (F.col("_side") == 1), F.col(value)))
        frac = F.max(F.when(F.col("_i") == i, F.col("_frac")))
        aggs.append((lo + (hi - lo) * frac).alias(f"q{i}"))
    out = picked.groupBy(*keys).agg(*aggs)
    return out if by else out.drop("_g").select(*[F.max(f"q{i}").alias(f"q{i}") for i in range(len(probs))])


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal; the right side's keys are dropped."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def _targets(counts: DataFrame, keys: list[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Per group and wanted order statistic: its rank and the whole range as its interval.

    ``_i, _side`` name the statistic, ``_k`` is its rank, ``_frac`` the weight of
    the upper side, ``_start`` the rows before the interval, ``_d`` its distinct values.
    """
    stats = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                      F.count("*").alias("_d"))
    wanted = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for side, k in ((0, F.floor(pos)), (1, F.ceil(pos))):
            wanted.append(F.struct(F.lit(i).alias("_i"), F.lit(side).alias("_side"), k.alias("_k"),
                                   (pos - F.floor(pos)).alias("_frac")))
    return stats.select(*keys, F.explode(F.array(*wanted)).alias("w"), F.lit(0).cast("long").alias("_start"), "_lo", "_hi", "_d") \
        .select(*keys, "w.*", "_start", "_lo", "_hi", "_d")


def _in_intervals(counts: DataFrame, targets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values inside the target intervals; a group's intervals are equal or disjoint."""
    intervals = targets.select(*keys, "_start", "_lo", "_hi").distinct()
    return _null_safe_join(counts, intervals, keys).where(F.col(value).between(F.col("_lo"), F.col("_hi")))


def _refine(counts: DataFrame, targets: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """The targets with their intervals shrunk to one of ``buckets`` parts."""
    v, lo, hi = (F.col(c).cast("double") for c in (value, "_lo", "_hi"))
    wide = (hi - lo) == float("inf")  # then halves still have a finite difference
    share = F.when(wide, (v / 2 - lo / 2) / (hi / 2 - lo / 2)).when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0)
    part = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
    parts = _in_intervals(counts, targets, keys, value).withColumn("_b", part).groupBy(*keys, "_start", "_b").agg(
        F.sum("_c").alias("_bc"), F.min(value).alias("_blo"), F.max(value).alias("_bhi"), F.count("*").alias("_bd"))
    w = Window.partitionBy(*keys, "_start").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.select(*keys, F.col("_start").alias("_from"), "_blo", "_bhi", "_bd", "_bc",
                          (F.col("_start") + F.sum("_bc").over(w) - F.col("_bc")).alias("_bstart"))
    joined = _null_safe_join(targets.select(*keys, "_i", "_side", "_k", "_frac", F.col("_start").alias("_from")), placed,
                             [*keys, "_from"])
    return joined.where((F.col("_k") >= F.col("_bstart")) & (F.col("_k") < F.col("_bstart") + F.col("_bc"))).select(
        *keys, "_i", "_side", "_k", "_frac", F.col("_bstart").alias("_start"), F.col("_blo").alias("_lo"),
        F.col("_bhi").alias("_hi"), F.col("_bd").alias("_d"))


def _pick(counts: DataFrame, targets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of every target, ranked inside its interval."""
    w = Window.partitionBy(*keys, "_start").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _in_intervals(counts, targets, keys, value).select(
        *keys, "_start", value, (F.col("_start") + F.sum("_c").over(w) - F.col("_c")).alias("_vs"), F.col("_c").alias("_vc"))
    joined = _null_safe_join(targets.select(*keys, "_i", "_side", "_k", "_frac", "_start"), ranked, [*keys, "_start"])
    return joined.where((F.col("_k") >= F.col("_vs")) & (F.col("_k") < F.col("_vs") + F.col("_vc")))


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max per group (A-14).

    Moments come from one partial/final aggregate over the rows (Spark merges
    mean/variance states stably); quantiles from the distributed selection
    above.  No group is gathered into one task.
    """
    by = list(by)
    v = F.col(value)
    rows = df.where(v.isNotNull())
    moments = (rows.groupBy(*by) if by else rows.groupBy()).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(df, by, value, (0.25, 0.5, 0.75)) \
        .withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})
    if by:
        joined = _null_safe_join(moments, q, by, "left")
    else:  # two one-row results: attach the quantiles as one scalar subquery
        one = q.select(F.struct("p25", "p50", "p75")).scalar()
        joined = moments.select("*", one.alias("_q")).select("*", "_q.*")
    return joined.select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def equal_width_bin(x: str | Column, lo: Column, hi: Column, bins: int, right_closed: bool = False) -> Column:
    """1-based equal-width bin of ``x`` on [lo, hi] (A-22, F-21).

    Left-closed (histogram): ``floor((x - lo) / (hi - lo) * bins) + 1`` with
    the maximum clamped into the last bin.  Right-closed (``pd.cut``):
    ``ceil(...)`` with the minimum clamped into the first bin.
    """
    xd = _col(x).cast("double")
    scaled = (xd - lo) / (hi - lo) * bins
    raw = F.ceil(scaled) if right_closed else F.floor(scaled) + 1
    return F.when(hi == lo, F.lit(1)).otherwise(F.least(F.greatest(raw, F.lit(1)), F.lit(bins))).cast("int")


def bin_by_edges(x: str | Column, edges: Sequence[Column]) -> Column:
    """1-based bin for right-closed edges e0 < e1 < ... (first bin includes e0)."""
    xd = _col(x)
    expr = None
    for i, edge in enumerate(edges[1:], start=1):
        cond = xd <= edge
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def value_at_offset(value: str | Column, by: Sequence[str], order: str, offset: int) -> Column:
    """The value exactly ``offset`` order units earlier (a range frame), so a
    missing period yields null instead of silently pairing the wrong rows."""
    w = Window.partitionBy(*by).orderBy(order).rangeBetween(-offset, -offset)
    return F.first(_col(value)).over(w)


def change_vs_offset(value: str | Column, by: Sequence[str], order: str, offset: int) -> tuple[Column, Column]:
    """(difference, % change) against the value ``offset`` units earlier (W-2, W-3)."""
    prev = value_at_offset(value, by, order, offset)
    v = _col(value).cast("double")
    return v - prev, F.try_divide(v - prev, prev.cast("double")) * 100.0
