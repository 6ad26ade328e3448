"""Observer-versus-observer audit (A-23 .. A-28, F-19, F-22).

The sender is the entity that publishes its own count; the receiver is the
party that counts what it received from that entity.  Everything works on
one ``audit`` DataFrame keyed by ``(entity, year)``; the statistics that the
reference ran in a separate R process are further aggregates of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.stats import binomial_upper_tail, hypergeometric_upper_tail

# The severity bin edges of |delta%| (right-closed) and the
# audit table's column order.
SEVERITY_EDGES = (-0.1, 5.0, 30.0, 100.0)
AUDIT_COLUMNS = (
    "entity", "year", "pieces", "pi", "reports", "delta_pct", "received",
    "esp_pct", "esp", "total_pct", "total", "esp_total_pct",
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent_difference(sent: str | Column, received: str | Column, base: str = "mean") -> Column:
    """(received - sent) relative to the mean of both (or the sender), in % (F-19)."""
    s, r = _col(sent).cast("double"), _col(received).cast("double")
    denominator = (r + s) / 2.0 if base == "mean" else s
    return F.try_divide(r - s, denominator) * 100.0


def compare_observers(df: DataFrame) -> DataFrame:
    """Audit columns from ``pieces, reports`` (sender), ``received``,
    ``esp`` (industry total) and ``total`` (grand total) (A-26).

    The denominators fall back to the other observer when one is missing;
    division by zero yields null rather than an error.
    """
    sent, received = F.col("reports").cast("double"), F.col("received").cast("double")
    return df.select(
        "entity", "year", "pieces",
        F.try_divide(F.col("pieces").cast("double"), F.coalesce(sent, received)).alias("pi"),
        "reports",
        percent_difference(sent, received).alias("delta_pct"),
        "received",
        (F.try_divide(F.coalesce(received, sent), F.col("esp").cast("double")) * 100.0).alias("esp_pct"),
        "esp",
        (F.try_divide(F.coalesce(received, sent), F.col("total").cast("double")) * 100.0).alias("total_pct"),
        "total",
        (F.try_divide(F.col("esp").cast("double"), F.col("total").cast("double")) * 100.0).alias("esp_total_pct"),
    )


def comparable_pairs(audit: DataFrame, sender_label: str = "ServiceProvider",
                     receiver_label: str = "Receiver", topic: str = "reports") -> DataFrame:
    """Years where both observers have a count, in long form (A-28).

    ``id`` is topic + year; ``observer`` is anonymised to two labels.
    """
    both = audit.where(F.col("reports").isNotNull() & F.col("received").isNotNull())
    long = both.select(
        "entity", "year",
        F.col("reports").cast("double").alias(sender_label),
        F.col("received").cast("double").alias(receiver_label),
    ).unpivot(["entity", "year"], [sender_label, receiver_label], "observer", "count")
    return long.select(
        F.concat(F.col("entity"), F.lit("-"), F.col("year").cast("string")).alias("id"),
        F.col("entity").alias("topic"),
        "year",
        "observer",
        F.col("count").cast("bigint").alias("count"),
    )


def comparable_by_provider(audit: DataFrame, receiver_label: str = "Receiver") -> DataFrame:
    """``year, observer, count, topic``: years where both count, observers by name (A-28)."""
    both = audit.where(F.col("reports").isNotNull() & F.col("received").isNotNull())
    pair = F.explode(F.array(
        F.struct(F.col("entity").alias("observer"), F.col("reports").cast("bigint").alias("count")),
        F.struct(F.lit(receiver_label).alias("observer"), F.col("received").cast("bigint").alias("count"))))
    return both.select("year", pair.alias("p"), F.col("entity").alias("topic")).select("year", "p.observer", "p.count", "topic")


def comparable_anonymous(named: DataFrame, receiver_label: str = "Receiver",
                         sender_label: str = "ServiceProvider") -> DataFrame:
    """``id, year, observer, count``: the sender's name only as part of the row's id (A-28)."""
    return named.select(
        F.concat("topic", F.col("year").cast("string")).alias("id"), "year",
        F.when(F.col("observer") == receiver_label, F.col("observer")).otherwise(F.lit(sender_label)).alias("observer"), "count")


def pair_differences(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Mean, difference (second - first) and % difference per pair id (A-23).

    One conditional aggregate per id: no self-join, and each group holds
    exactly two rows however skewed the ids are.
    """
    g = pairs.groupBy("id").agg(
        F.max(F.when(F.col("observer") == first, F.col("count"))).cast("double").alias("_a"),
        F.max(F.when(F.col("observer") == second, F.col("count"))).cast("double").alias("_b"),
    )
    return g.select(
        "id",
        ((F.col("_a") + F.col("_b")) / 2.0).alias("mean"),
        (F.col("_b") - F.col("_a")).alias("diff"),
        (F.try_divide(F.col("_b") - F.col("_a"), (F.col("_a") + F.col("_b")) / 2.0) * 100.0).alias("pct_diff"),
    )


def bland_altman(diffs: DataFrame) -> DataFrame:
    """Summary of the % differences: mean, y-limit max(|.|), x range (A-23)."""
    return diffs.agg(
        F.count("*").alias("n_pairs"),
        F.avg("pct_diff").alias("mean_pct_diff"),
        F.max(F.abs("pct_diff")).alias("ymax"),
        F.min("mean").alias("xmin"),
        F.max("mean").alias("xmax"),
    )


def sign_tally(diffs: DataFrame, value: str = "pct_diff") -> DataFrame:
    """Count of positive, zero and negative differences (A-24)."""
    return diffs.groupBy(F.signum(value).cast("int").alias("sign")).agg(F.count("*").alias("n"))


def sign_test(diffs: DataFrame, value: str = "pct_diff") -> DataFrame:
    """One-sided sign test: P(X >= #positive) for X ~ Bin(#non-zero, 1/2) (A-24)."""
    counts = diffs.agg(
        F.count_if(F.col(value) > 0).alias("positive"),
        F.count_if(F.col(value) != 0).alias("n"),
    )
    return counts.select("positive", "n", binomial_upper_tail(F.col("positive"), F.col("n"), 0.5).alias("p_value"))


def severity_bin(c: str | Column, edges: Sequence[float] = SEVERITY_EDGES) -> Column:
    """Bin index of |delta%| on right-closed edges; beyond the last edge -> last bin (F-22)."""
    x = F.abs(_col(c))
    expr = None
    for i, edge in enumerate(edges[1:]):
        expr = F.when(x <= edge, F.lit(i)) if expr is None else expr.when(x <= edge, F.lit(i))
    return expr.when(x.isNotNull(), F.lit(len(edges) - 1))


def outlier_contingency(df: DataFrame, group: Column, is_outlier: Column) -> DataFrame:
    """2x2 counts: group member vs other, outlier vs close (A-25)."""
    return (
        df.select(group.alias("in_group"), is_outlier.alias("outlier"))
        .groupBy("in_group")
        .pivot("outlier", [True, False])
        .count()
        .select(
            "in_group",
            F.coalesce(F.col("true"), F.lit(0)).cast("bigint").alias("outlier"),
            F.coalesce(F.col("false"), F.lit(0)).cast("bigint").alias("close"),
        )
    )


def fisher_greater(contingency: DataFrame) -> DataFrame:
    """One-sided Fisher exact test on the 2x2 table from ``outlier_contingency``."""
    t = contingency.agg(
        F.sum(F.when(F.col("in_group"), F.col("outlier"))).alias("a"),
        F.sum(F.when(~F.col("in_group"), F.col("outlier"))).alias("c"),
        F.sum(F.when(F.col("in_group"), F.col("close"))).alias("b"),
        F.sum(F.when(~F.col("in_group"), F.col("close"))).alias("d"),
    ).na.fill(0)
    return t.select("a", "b", "c", "d", hypergeometric_upper_tail("a", "b", "c", "d").alias("p_value"))


def audit_observers(sender: DataFrame, receiver: DataFrame, ownership: DataFrame,
                    totals: DataFrame, exclude: Sequence[str] = (),
                    include_redundant: bool = False, bounded_ownership: bool = False) -> DataFrame:
    """Audit every entity's own count against the receiver's count (A-27).

    ``sender``/``receiver`` are observation tables; ``totals(year, esp,
    total)``.  Steps: drop redundant sender rows (P-12), annualise (A-6),
    fold members into owners on both sides (J-10), lay the receiver's
    calendar spine under every receiver entity (J-9) and compute the audit
    columns (A-26).  One DataFrame for all entities; no per-entity loop.
    """
    from veracity.operators.observations import drop_redundant
    from veracity.operators.rollup import annualize, calendar_spine, rollup

    sent = rollup(annualize(drop_redundant(sender, include_redundant)), ownership,
                  bounded_ownership=bounded_ownership)
    # Conditional aggregates = pivot with the value list given (R-3).
    sent_wide = sent.groupBy("entity", F.col("period.year").alias("year")).agg(
        F.sum(F.when(F.col("metric") == "pieces", F.col("value"))).alias("pieces"),
        F.sum(F.when(F.col("metric") == "reports", F.col("value"))).alias("reports"),
    )
    got = (
        rollup(receiver.where(F.col("metric") == "reports"), ownership, bounded_ownership=bounded_ownership)
        .select("entity", F.col("period.year").alias("year"), F.col("value").alias("received"))
    )
    entities = got.select("entity").distinct()
    if exclude:
        entities = entities.where(~F.col("entity").isin(*exclude))
    spine = calendar_spine(entities, got)
    joined = (
        spine.join(sent_wide, ["entity", "year"], "left")
        .join(got, ["entity", "year"], "left")
        .join(totals, "year", "left")
    )
    return compare_observers(joined)
