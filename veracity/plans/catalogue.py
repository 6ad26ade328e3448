"""Query catalogue over the driver tables.

Each query is ``(spark, sf_dir) -> DataFrame`` and reads whole tables.
Queries are grouped by pipeline; the DuckDB twins live in
:mod:`veracity.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.operators import audit as A
from veracity.plans import domain as D

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = D.order_facts(spark, sf_dir)
    return A.audit_observers(
        D.sender_observations(facts),
        D.receiver_observations(facts),
        D.ownership(spark, sf_dir),
        D.yearly_totals(facts),
        bounded_ownership=True,
    )


# --------------------------------------------------------------------------
# Observer vs observer


@query
def audit_by_region_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship (A-27): P-12, A-6, J-10, J-9, A-26, F-19 over
    orders/lineitem/customer/nation/region, sorted by entity then year (T-5)."""
    return _audit(spark, sf_dir).orderBy("entity", "year")


def _r(c, digits: int = 9):
    """Round float results whose low bits depend on summation order."""
    return F.round(c if not isinstance(c, str) else F.col(c), digits)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.comparable_pairs(_audit(spark, sf_dir))


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pair_differences(_pairs(spark, sf_dir), "ServiceProvider", "Receiver")


# The audit's outlier rule (|delta%| above the threshold) and
# the group tested against the rest.
OUTLIER_THRESHOLD = 1.5
OUTLIER_GROUP = "AMERICA"


@query
def audit_comparable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-28, R-1, P-8: years where both observers count, long and anonymised."""
    return _pairs(spark, sf_dir)


@query
def bland_altman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-23: mean % difference and limits over all comparable pairs."""
    s = A.bland_altman(_diffs(spark, sf_dir))
    return s.select("n_pairs", _r("mean_pct_diff").alias("mean_pct_diff"), _r("ymax").alias("ymax"),
                    "xmin", "xmax")


@query
def sign_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24: positive / zero / negative differences."""
    return A.sign_tally(_diffs(spark, sf_dir))


@query
def sign_test_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24: one-sided sign test on the non-zero differences."""
    t = A.sign_test(_diffs(spark, sf_dir))
    return t.select("positive", "n", _r("p_value", 12).alias("p_value"))


@query
def severity_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-22: audit rows per severity bin of |delta%|."""
    a = _audit(spark, sf_dir).where(F.col("delta_pct").isNotNull())
    return a.groupBy(A.severity_bin("delta_pct").alias("severity")).agg(F.count("*").alias("n"))


def _contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _audit(spark, sf_dir).where(F.col("delta_pct").isNotNull())
    return A.outlier_contingency(
        d, F.col("entity") == OUTLIER_GROUP, F.abs(F.col("delta_pct")) > OUTLIER_THRESHOLD
    )


@query
def outlier_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-25: 2x2 table of group x outlier."""
    return _contingency(spark, sf_dir)


@query
def outlier_fisher_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-25: one-sided Fisher exact test on that table."""
    t = A.fisher_greater(_contingency(spark, sf_dir))
    return t.select("a", "b", "c", "d", _r("p_value", 12).alias("p_value"))


@query
def returns_fisher_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24, A-25 on counts as large as the table: per ship year, are line items with a
    high discount returned more often (one- and two-sided), and do they outnumber the rest?"""
    from veracity.functions.stats import binomial_upper_tail, fisher_two_sided, hypergeometric_upper_tail
    from veracity.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem")
    high, back = F.col("l_discount") >= 0.05, F.col("l_returnflag") == "R"
    t = li.groupBy(F.year("l_shipdate").alias("year")).agg(
        F.count_if(high & back).alias("a"), F.count_if(high & ~back).alias("b"),
        F.count_if(~high & back).alias("c"), F.count_if(~high & ~back).alias("d"))
    return t.select("year", "a", "b", "c", "d",
                    _r(hypergeometric_upper_tail("a", "b", "c", "d")).alias("p_greater"),
                    _r(fisher_two_sided("a", "b", "c", "d")).alias("p_two_sided"),
                    _r(binomial_upper_tail(F.col("a") + F.col("b"), F.expr("a + b + c + d"))).alias("p_majority"))


# --------------------------------------------------------------------------
# Annualising and rollup


def _flat(obs: DataFrame) -> DataFrame:
    return obs.select("entity", "observer", F.col("period.label").alias("label"),
                      F.col("period.year").alias("year"), "metric", "value")


@query
def annualize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-6, P-12, F-4: mixed Q/H sender rows (redundant totals dropped) to years covering January..December."""
    from veracity.operators.observations import drop_redundant
    from veracity.operators.rollup import annualize
    facts = D.order_facts(spark, sf_dir, materialize=False)
    return _flat(annualize(drop_redundant(D.sender_observations(facts))))


# Fixed value: the cell knocked out before strict annualising (P-13).
KNOCKOUT = ("1997 Q2", "pieces")


@query
def annualize_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-7, F-6: per metric, a year's value only when its quarter bitmap is full."""
    from veracity.operators.observations import drop_redundant
    from veracity.operators.rollup import annualize_strict as strict
    facts = D.order_facts(spark, sf_dir, materialize=False)
    obs = drop_redundant(D.sender_observations(facts))
    knocked = obs.withColumn("value", F.when(
        (F.col("period.label") == KNOCKOUT[0]) & (F.col("metric") == KNOCKOUT[1]), F.lit(None)
    ).otherwise(F.col("value")))
    return _flat(strict(knocked)).drop("label", "observer")


def _receiver_rollup(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    from veracity.operators.rollup import rollup
    facts = D.order_facts(spark, sf_dir, materialize=False)
    rolled = rollup(D.receiver_observations(facts), D.ownership(spark, sf_dir), bounded_ownership=True, **kw)
    return rolled.select("entity", F.col("period.year").alias("year"), "value")


@query
def rollup_drop_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10, A-2: members folded into owners (null only when all inputs are null)."""
    return _receiver_rollup(spark, sf_dir)


@query
def rollup_keep_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10: owner totals plus the members' own rows."""
    return _receiver_rollup(spark, sf_dir, keep_members=True)


# Fixed value: the owner whose members stay separate (the reference skips one firm).
EXCLUDED_OWNER = "ASIA"


@query
def rollup_exclude_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10 with one owner excluded from folding."""
    return _receiver_rollup(spark, sf_dir, exclude_owners=(EXCLUDED_OWNER,))


# The owners (TPC-H region names) used as pivot columns.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query
def wide_receiver_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-2, R-3, T-3: receiver counts per year with one column per owner."""
    from veracity.operators.reshape import pivot_values
    return pivot_values(_receiver_rollup(spark, sf_dir), ["year"], "entity", "value", REGIONS, "sum").orderBy("year")


@query
def long_receiver_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-4: the same rollup kept long, with observer and metric."""
    from veracity.operators.rollup import rollup
    facts = D.order_facts(spark, sf_dir, materialize=False)
    rolled = rollup(D.receiver_observations(facts), D.ownership(spark, sf_dir), bounded_ownership=True)
    return rolled.select("entity", "observer", F.col("period.year").alias("year"), "metric", "value") \
        .orderBy("year", "entity")


# --------------------------------------------------------------------------
# Snapshot versus snapshot


def _snap_diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from veracity.operators.revisions import diff_snapshots
    snaps = D.revenue_snapshots(spark, sf_dir)
    return snaps, diff_snapshots(snaps, list(D.SNAPSHOT_KEYS), "snapshot", "cents")


@query
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-4: restated values between consecutive quarterly snapshots (T-2 multi-key sort)."""
    return _snap_diff(spark, sf_dir)[1].orderBy("snapshot", "period", "nation", "priority", "status")


@query
def divergence_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-9: share of the earlier snapshot's values that changed."""
    from veracity.operators.revisions import divergence_rate as rate
    snaps, diffs = _snap_diff(spark, sf_dir)
    return rate(snaps, diffs)


@query
def divergence_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-8: divergent values per historical period and snapshot."""
    from veracity.operators.revisions import divergence_age as age
    return age(_snap_diff(spark, sf_dir)[1], "period")


@query
def divergence_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-10: distinct priorities and statuses seen in each delta."""
    from veracity.operators.revisions import divergence_descriptors as desc
    return desc(_snap_diff(spark, sf_dir)[1], ["priority", "status"])


# Fixed value: the snapshot read by label, in the alternative spelling (F-2).
SNAPSHOT_LABEL = "2000q4"


@query
def quarter_latest_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-8, P-11, F-2, F-3: one snapshot chosen by label, newest period dropped."""
    from veracity.functions.periods import parse_quarter, quarter_label
    from veracity.operators.revisions import snapshot_as_of
    chosen = snapshot_as_of(D.revenue_increments(spark, sf_dir), ["nation", "priority", "status"], "period", "known_at",
                            "cents", parse_quarter(F.lit(SNAPSHOT_LABEL)))
    newest = chosen.select(F.max("period")).scalar()
    return chosen.where(F.col("period") != newest).select(
        "nation", "priority", "status", quarter_label("period").alias("period_label"),
        (F.col("period") + 1).alias("next_period"), "cents",
    )


# --------------------------------------------------------------------------
# Per-key enrichment


def _per_capita(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veracity.operators.enrich import member_flag, per_capita
    from veracity.operators.trends import share_of_group
    base = D.orders_by_nation_year(spark, sf_dir)
    reports = base.select("nation", "year", "reports",
                          share_of_group("reports", ["year"]).alias("reports_pct"))
    population = base.select("nation", "year", "population",
                             share_of_group("population", ["year"]).alias("population_pct"))
    joined = per_capita(reports, population, ["nation", "year"])
    joined = joined.join(D.nation_dims(spark, sf_dir), "nation", "left")
    league = D.nations_with_rich_suppliers(spark, sf_dir, D.LEAGUE_BALANCE)
    return member_flag(joined, league, "nation", "league")


@query
def per_capita_by_nation_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1, J-2, J-7, F-20, A-15: facts joined to denominators and dimensions."""
    return _per_capita(spark, sf_dir)


@query
def rank_per_capita(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-1: rank within year by reports per capita, descending."""
    from veracity.operators.trends import rank_within
    pc = _per_capita(spark, sf_dir)
    return pc.select("nation", "year", "reports_per_capita",
                     rank_within(["year"], [F.desc("reports_per_capita"), F.asc("nation")]).alias("rank"))


# Fixed value: how many top ranks the top-k reports keep.
TOP_K = 10


@query
def topk_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-4, T-1: the top-k nations per year by reports per capita (the limit is the feature)."""
    return rank_per_capita(spark, sf_dir).where(F.col("rank") <= TOP_K).orderBy("year", "rank")


def _with_league_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veracity.operators.enrich import summary_rows
    pc = _per_capita(spark, sf_dir)
    return summary_rows(
        pc, F.col("league"), ["year"], ["reports", "population", "reports_pct", "population_pct"],
        {"nation": "LEAGUE", "league": False},
        ratios={"reports_per_capita": ("reports", "population")},
    )


@query
def league_summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-17, U-1: one synthetic row per year summing the league's members."""
    t = _with_league_row(spark, sf_dir)
    return t.withColumn("reports_pct", _r("reports_pct")).withColumn("population_pct", _r("population_pct"))


@query
def rank_of_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-7: where the league's summary row ranks among the nations each year."""
    from veracity.operators.trends import rank_within
    t = _with_league_row(spark, sf_dir)
    ranked = t.select("nation", "year",
                      rank_within(["year"], [F.desc("reports_per_capita"), F.asc("nation")]).alias("rank"))
    return ranked.where(F.col("nation") == "LEAGUE").select("year", "rank")


@query
def members_in_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-7: league members among each year's top k."""
    from veracity.operators.trends import rank_within
    t = _with_league_row(spark, sf_dir)
    ranked = t.withColumn("rank", rank_within(["year"], [F.desc("reports_per_capita"), F.asc("nation")]))
    return ranked.where(F.col("rank") <= TOP_K).groupBy("year").agg(
        F.count_if(F.col("league")).alias("members"))


@query
def survey_total_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-17: per-status order counts with a 'Total' row per year appended."""
    from veracity.operators.enrich import summary_rows
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    counts = o.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")) \
        .agg(F.count("*").alias("orders"))
    return summary_rows(counts, F.lit(True), ["year"], ["orders"], {"status": "Total"})


@query
def region_rollup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-16, J-3: regional sums with the ratio recomputed from the sums, and
    each region's top level from a two-level hierarchy self-join."""
    from veracity.operators.enrich import resolve_parent
    pc = _per_capita(spark, sf_dir)
    regional = pc.groupBy("year", "region").agg(F.sum("reports").alias("reports"),
                                                F.sum("population").alias("population"))
    dims = D.nation_dims(spark, sf_dir)
    hierarchy = dims.select(F.col("nation").alias("child"), F.col("region").alias("parent")).unionByName(
        dims.select(F.col("region").alias("child"), F.lit("WORLD").alias("parent")).distinct())
    tops = resolve_parent(hierarchy).where(F.col("parent") != "WORLD") \
        .select(F.col("parent").alias("region"), "top").distinct()
    return regional.join(tops, "region", "left").select(
        "year", "region", "top", "reports", "population",
        F.try_divide(F.col("reports").cast("double"), F.col("population").cast("double")).alias("reports_per_capita"),
    ).orderBy("year", F.desc("reports_per_capita"), "region")


@query
def facts_without_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-8: nations with orders but no supplier above the balance bar, and their totals."""
    from veracity.operators.enrich import without_denominator
    base = D.orders_by_nation_year(spark, sf_dir, materialize=False)
    denominators = D.nations_with_rich_suppliers(spark, sf_dir, D.DENOMINATOR_BALANCE)
    return without_denominator(base, denominators, "nation", ["year"], "reports")


@query
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15, W-5: orders per status as a share of the year's total."""
    from veracity.operators.trends import group_total, share_of_group
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    counts = o.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")) \
        .agg(F.count("*").alias("orders"))
    return counts.select("year", "status", "orders", group_total("orders", ["year"]).alias("year_total"),
                         share_of_group("orders", ["year"]).alias("share"))


@query
def running_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-4: cumulative share of nations ordered by orders, descending."""
    from veracity.operators.trends import running_share as rs
    base = D.orders_by_nation_year(spark, sf_dir, materialize=False)
    return base.select("nation", "year", "reports",
                       rs("reports", ["year"], [F.desc("reports"), F.asc("nation")]).alias("running_share"))


# Fixed value: share (%) above which a nation is listed by name (A-18).
TOP_SHARE_THRESHOLD = 4.2


@query
def top_share_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18: nations above the share threshold plus an 'Others' residual."""
    from veracity.operators.trends import top_shares_with_others
    base = D.orders_by_nation_year(spark, sf_dir, materialize=False)
    t = top_shares_with_others(base, "nation", "reports", ["year"], TOP_SHARE_THRESHOLD)
    return t.withColumn("share", _r("share"))


# --------------------------------------------------------------------------
# Trends, fits and distributions


def _quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.orders_by_nation_month(spark, sf_dir)
    return m.groupBy("nation", (F.col("year") * 4 + F.floor((F.col("month") - 1) / 3)).cast("int").alias("qidx")) \
        .agg(F.sum("orders").alias("orders"))


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.orders_by_nation_month(spark, sf_dir).groupBy("nation", "year").agg(F.sum("orders").alias("orders"))


@query
def yoy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-3: year-over-year % change at quarter grain (same quarter a year earlier)."""
    from veracity.operators.trends import change_vs_offset
    q = _quarterly(spark, sf_dir)
    _, pct = change_vs_offset("orders", ["nation"], "qidx", 4)
    return q.select("nation", "qidx", "orders", pct.alias("yoy_pct"))


@query
def growth_fixed_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-2, P-17: change to the previous year and % of the base year."""
    from veracity.operators.trends import change_vs_offset, percent_of_base
    y = _yearly(spark, sf_dir)
    diff, _ = change_vs_offset("orders", ["nation"], "year", 1)
    return y.select("nation", "year", "orders", diff.alias("diff"),
                    percent_of_base("orders", ["nation"], "year", D.BASE_YEAR).alias("pct_of_base"))


@query
def growth_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-6: z-score of each nation's yearly growth among its own years."""
    from veracity.operators.trends import change_vs_offset, zscore
    y = _yearly(spark, sf_dir)
    _, pct = change_vs_offset("orders", ["nation"], "year", 1)
    g = y.select("nation", "year", pct.alias("growth")).where(F.col("growth").isNotNull())
    return g.select("nation", "year", _r("growth").alias("growth"), _r(zscore("growth", ["nation"])).alias("z"))


@query
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-19: least-squares line of monthly orders per nation."""
    from veracity.operators.trends import linear_fit as fit
    f = fit(D.orders_by_nation_month(spark, sf_dir), ["nation"], "x", "orders")
    return f.select("nation", _r("slope", 6).alias("slope"), _r("intercept", 6).alias("intercept"), "n")


# Fixed value: the breakpoint of the piecewise fit (months since the base year).
BREAKPOINT_X = 36


@query
def piecewise_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-20: two lines split at the breakpoint (x < bp, x >= bp)."""
    from veracity.operators.trends import piecewise_fit as fit
    f = fit(D.orders_by_nation_month(spark, sf_dir), ["nation"], "x", "orders", BREAKPOINT_X)
    return f.select("nation", "segment", _r("slope", 6).alias("slope"), _r("intercept", 6).alias("intercept"), "n")


@query
def exp_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21: exponential fit ln(y) = a + b x per nation."""
    from veracity.operators.trends import exp_fit as fit
    f = fit(D.orders_by_nation_month(spark, sf_dir), ["nation"], "x", "orders")
    return f.select("nation", _r("rate", 6).alias("rate"), _r("log_scale", 6).alias("log_scale"))


@query
def weighted_exp_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21: exponential fit weighted by y on the squared residuals."""
    from veracity.operators.trends import exp_fit as fit
    f = fit(D.orders_by_nation_month(spark, sf_dir), ["nation"], "x", "orders", weighted=True)
    return f.select("nation", _r("rate", 6).alias("rate"), _r("log_scale", 6).alias("log_scale"))


@query
def fit_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-13: mean squared error of the linear and exponential fits per nation."""
    from veracity.operators.trends import exp_fit as efit, linear_fit as lfit, mean_squared_error
    m = D.orders_by_nation_month(spark, sf_dir)
    lin = lfit(m, ["nation"], "x", "orders")
    ex = efit(m, ["nation"], "x", "orders")
    fitted = m.join(lin, "nation").join(ex, "nation").select(
        "nation", "orders",
        (F.col("intercept") + F.col("slope") * F.col("x")).alias("linear"),
        F.exp(F.col("log_scale") + F.col("rate") * F.col("x")).alias("exponential"),
    ).unpivot(["nation", "orders"], ["linear", "exponential"], "model", "fit")
    return fitted.groupBy("nation", "model").agg(_r(mean_squared_error("orders", "fit"), 6).alias("mse"))


@query
def describe_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-14: count, mean, std, min, quartiles (exact), max of line prices per return flag."""
    from veracity.operators.trends import describe
    from veracity.sources.tables import read_table
    d = describe(read_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return d.select("l_returnflag", "count", _r("mean", 6).alias("mean"), _r("std", 6).alias("std"),
                    "min", _r("p25", 6).alias("p25"), _r("p50", 6).alias("p50"), _r("p75", 6).alias("p75"), "max")


@query
def histogram_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-22: ten equal-width bins of line prices, maximum in the last bin."""
    from veracity.operators.trends import equal_width_bin
    from veracity.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem")
    b = li.select(F.struct(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))).scalar()
    # Attach the bounds once as a column: one subquery reference, however often it is used.
    li = li.select("l_extendedprice", b.alias("_b"))
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    return li.groupBy(equal_width_bin("l_extendedprice", lo, hi, 10).alias("bin")).agg(F.count("*").alias("n"))


@query
def cut_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-21: five right-closed equal-width bins of line quantities (pd.cut)."""
    from veracity.operators.trends import equal_width_bin
    from veracity.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem")
    b = li.select(F.struct(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))).scalar()
    # Attach the bounds once as a column: one subquery reference, however often it is used.
    li = li.select("l_quantity", b.alias("_b"))
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    return li.groupBy(equal_width_bin("l_quantity", lo, hi, 5, right_closed=True).alias("bin")) \
        .agg(F.count("*").alias("n"))


@query
def qcut_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-21: quartile bins of order prices from exact quantile edges (pd.qcut)."""
    from veracity.operators.trends import bin_by_edges, exact_quantiles
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    q = exact_quantiles(o, [], "o_totalprice", (0.0, 0.25, 0.5, 0.75, 1.0))
    # All five edges in one scalar subquery, referenced once (as a column):
    # the quantile pipeline is planned and run a single time.
    bounds = q.select(F.struct(*[F.col(f"q{i}") for i in range(5)])).scalar()
    with_edges = o.select("o_totalprice", bounds.alias("_e"))
    edges = [F.col(f"_e.q{i}") for i in range(5)]
    return with_edges.groupBy(bin_by_edges("o_totalprice", edges).alias("bin")).agg(F.count("*").alias("n"))


@query
def reversal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-39: quarterly return percent -> counts -> yearly percent, per line status side by side."""
    from veracity.operators.reshape import side_by_side
    from veracity.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem")
    quarterly = li.groupBy(F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"),
                           "l_linestatus").agg(
        (F.count_if(F.col("l_returnflag") == "R") / F.count("*") * 100.0).alias("pct"),
        F.count("*").alias("total"))
    counts = quarterly.withColumn("returned", F.round(F.col("pct") * F.col("total") / 100.0).cast("bigint"))
    yearly = counts.groupBy("year", "l_linestatus").agg(
        (F.sum("returned") / F.sum("total") * 100.0).alias("pct"))
    frames = {f"{s}_pct": yearly.where(F.col("l_linestatus") == s) for s in ("F", "O")}
    return side_by_side(frames, ["year"], "pct")


@query
def multiplicity_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-40: lines per order and per distinct part, by ship year."""
    from veracity.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate").alias("year")
    # One aggregate per counted key: two distinct counts in one would copy every line before the shuffle.
    orders = li.groupBy(year, "l_orderkey").agg(F.count("*").alias("n")).groupBy("year").agg(
        F.sum("n").alias("lines"), F.count("l_orderkey").alias("orders"))
    parts = li.groupBy(year, "l_partkey").agg(F.count("*").alias("n")).groupBy(F.col("year").alias("part_year")).agg(
        F.count("l_partkey").alias("parts"))
    g = orders.join(parts, F.col("year").eqNullSafe(F.col("part_year")))
    return g.select("year", "lines", "orders", "parts",
                    (F.col("lines") / F.col("orders")).alias("lines_per_order"),
                    (F.col("lines") / F.col("parts")).alias("lines_per_part"))


# Fixed value: the owner whose members' shares are reported (A-38).
SHARE_OWNER = "ASIA"


@query
def member_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-38: owner share of the total and each member's share of the owner."""
    base = D.orders_by_nation_year(spark, sf_dir, materialize=False)
    own = D.ownership(spark, sf_dir)
    j = base.join(F.broadcast(own), base["nation"] == own["member"], "inner")
    from pyspark.sql import Window
    wy = Window.partitionBy("year")
    wo = Window.partitionBy("year", "owner")
    t = j.select("year", "owner", "nation", "reports",
                 F.sum("reports").over(wy).alias("total"),
                 F.sum("reports").over(wo).alias("owner_reports"))
    return t.where(F.col("owner") == SHARE_OWNER).select(
        "year", F.col("nation").alias("member"), F.col("reports").alias("member_reports"), "owner_reports", "total",
        (F.col("owner_reports") / F.col("total") * 100.0).alias("owner_pct"),
        (F.col("reports") / F.col("owner_reports") * 100.0).alias("member_pct"))


# The category and sub-category whose shares derive a count (A-37).
CATEGORY_STATUS = "F"
SUBCATEGORY_PRIORITY = "1-URGENT"


@query
def share_derived_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-37, P-17, F-17: total x category share x sub-share, truncated, per quarter."""
    from veracity.functions.cells import truncate_int
    from veracity.functions.periods import quarter_index_of_date
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    g = o.groupBy(quarter_index_of_date("o_orderdate").alias("qidx")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("o_orderstatus") == CATEGORY_STATUS).alias("_cat"),
        F.count_if((F.col("o_orderstatus") == CATEGORY_STATUS)
                   & (F.col("o_orderpriority") == SUBCATEGORY_PRIORITY)).alias("_sub"))
    cat = F.try_divide(F.col("_cat").cast("double"), F.col("total").cast("double"))
    sub = F.try_divide(F.col("_sub").cast("double"), F.col("_cat").cast("double"))
    return g.select("qidx", "total", cat.alias("category_share"), sub.alias("subcategory_share"),
                    truncate_int(F.col("total") * cat * sub).alias("derived"))


# Two taxonomies over the first word of the part type.
TAXONOMY = [
    ("size", "compact", "SMALL"), ("size", "compact", "MEDIUM"), ("size", "bulky", "LARGE"),
    ("grade", "basic", "ECONOMY"), ("grade", "basic", "STANDARD"), ("grade", "promoted", "PROMO"),
]


@query
def bucket_taxonomies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-16, A-1: line quantities per bucket under two taxonomies of part types."""
    from veracity.operators.enrich import assign_buckets
    from veracity.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("qty"), F.count("*").alias("lines"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").getItem(0).alias("label"))
    per_part = li.join(part, li["l_partkey"] == part["p_partkey"], "inner")
    tax = spark.createDataFrame(TAXONOMY, "taxonomy string, bucket string, member string")
    b = assign_buckets(per_part, tax, "label", bounded=True)
    return b.groupBy("taxonomy", "bucket").agg(F.sum("qty").alias("qty"), F.sum("lines").alias("lines"))


# The order statuses used as pivot columns.
STATUSES = ["F", "O", "P"]


@query
def interleaved_share_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-7, A-5: per year, each status's count followed by its share, plus the
    null-skipping row total of the counts."""
    from veracity.operators.reshape import interleave
    from veracity.operators.rollup import row_sum
    s = share_of_total(spark, sf_dir)
    w = interleave(s, ["year"], "status", STATUSES, "orders", "share")
    return w.withColumn("total", row_sum(*STATUSES))


@query
def split_name_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-6, R-1, F-12: columns named '<status> <variable>' unpivoted and split; one kind kept."""
    from veracity.operators.reshape import melt, split_variable
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    aggs = []
    for s in STATUSES:
        aggs.append(F.count_if(F.col("o_orderstatus") == s).alias(f"{s} orders"))
        aggs.append(F.count_distinct(F.when(F.col("o_orderstatus") == s, F.col("o_custkey"))).alias(f"{s} customers"))
    wide = o.groupBy(F.year("o_orderdate").alias("year")).agg(*aggs)
    long = melt(wide, ["year"], [c for c in wide.columns if c != "year"], "name", "value")
    return split_variable(long, "name", "status", "variable").where(F.col("variable") == "customers")


@query
def reach_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-41, P-9, J-5: customers ordering in Q2 as % of the year's ordering customers."""
    from veracity.functions.periods import period_of_date
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders").withColumn("p", period_of_date("o_orderdate", "Q"))
    q2 = o.where(F.col("p.label").endswith("Q2")).groupBy(F.col("p.year").alias("year")) \
        .agg(F.count_distinct("o_custkey").alias("active"))
    yearly = o.groupBy(F.col("p.year").alias("year")).agg(F.count_distinct("o_custkey").alias("population"))
    return q2.join(yearly, "year", "left").select(
        "year", "active", "population", (F.col("active") / F.col("population") * 100.0).alias("reach_pct"))


# --------------------------------------------------------------------------
# Parsing published cells and periods


@query
def parse_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-1, F-2, F-5: labels of every order quarter in all spellings, parsed back."""
    from veracity.functions.periods import (parse_period, parse_quarter, quarter_index, quarter_label)
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    yq = o.select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).distinct()
    q = quarter_index("year", "quarter")
    half = (F.floor((F.col("quarter") - 1) / 2) + 1).cast("int")
    t = yq.select(
        "year", "quarter", q.alias("qidx"),
        quarter_label(q, "space").alias("q_label"),
        F.format_string("%04d H%d", F.col("year"), half).alias("h_label"),
        F.format_string("%04d", F.col("year")).alias("y_label"),
        quarter_label(q, "months").alias("months_label"),
        quarter_label(q, "compact").alias("compact_label"),
        quarter_label(q, "dash").alias("dash_label"),
        quarter_label(q, "suffix").alias("suffix_label"),
    )
    pq, ph, py = parse_period("q_label"), parse_period("h_label"), parse_period("y_label")
    return t.select(
        "qidx", "q_label", pq["freq"].alias("q_freq"), pq["start_date"].alias("q_start"), pq["end_date"].alias("q_end"),
        "h_label", ph["freq"].alias("h_freq"), ph["start_date"].alias("h_start"), ph["end_date"].alias("h_end"),
        "y_label", py["start_date"].alias("y_start"), py["end_date"].alias("y_end"),
        "months_label", parse_quarter("months_label").alias("months_qidx"),
        "compact_label", parse_quarter("compact_label").alias("compact_qidx"),
        "dash_label", "suffix_label",
    )


def _cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untidy cells made from order prices: counts with separators,
    percentage expressions, percent strings and percent ranges."""
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    whole = F.floor("o_totalprice")
    pct = F.concat(F.floor(F.col("o_totalprice") / 10000).cast("string"), F.lit("."),
                   F.lpad(F.floor(F.col("o_totalprice") % 100).cast("string"), 2, "0"))
    return o.select(
        "o_orderkey",
        F.format_number(whole, 0).alias("count_text"),
        F.concat(pct, F.lit(" / 100 * "), F.format_number(whole, 0)).alias("expr_text"),
        F.concat(pct, F.lit("%")).alias("percent_text"),
        F.concat(F.floor(F.col("o_totalprice") / 100000).cast("string"), F.lit("%-"),
                 (F.floor(F.col("o_totalprice") / 100000) + 1).cast("string"), F.lit("%")).alias("range_text"),
    )


@query
def parse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-7, F-8, F-9: counts with thousands separators, percentage expressions, percents."""
    from veracity.functions.cells import parse_count, parse_percent, percent_expression
    c = _cell_texts(spark, sf_dir)
    e = percent_expression("expr_text")
    return c.select("o_orderkey", "count_text", parse_count("count_text").alias("count"),
                    "expr_text", e["percent"].alias("expr_percent"), e["total"].alias("expr_total"),
                    e["value"].alias("expr_value"), parse_percent("percent_text").alias("percent"))


@query
def range_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-10: percent ranges such as '4%-5%' to their midpoint."""
    from veracity.functions.cells import range_midpoint as mid
    c = _cell_texts(spark, sf_dir)
    return c.select("o_orderkey", "range_text", mid("range_text").alias("midpoint"))


@query
def sig_digits_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-18: order prices rounded to three significant digits."""
    from veracity.functions.cells import round_significant
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_totalprice", round_significant("o_totalprice", 3).alias("sig3"))


# --------------------------------------------------------------------------
# Quality


@query
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-30: column, type and null count of every driver table."""
    from veracity.operators.quality import schema_profile as profile
    from veracity.sources.tables import TABLES, read_table
    out = None
    for t in TABLES:
        p = profile(read_table(spark, sf_dir, t), t)
        out = p if out is None else out.unionByName(p)
    return out


@query
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-11, A-29: counts, nulls, distincts, shares summing to 100 and parts equal to totals."""
    from veracity.operators.quality import Check, run_checks
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    orders_checks = run_checks(o, [
        Check("orders_null_custkey", F.count_if(F.col("o_custkey").isNull()), 0),
        Check("orders_status_values", F.count_distinct("o_orderstatus"), 3),
        Check("orders_unique_keys", F.count_distinct("o_orderkey"), F.count("*")),
    ])
    pc = _per_capita(spark, sf_dir)
    share_checks = run_checks(pc, [
        Check("reports_pct_sum_per_year", F.sum("reports_pct") / F.count_distinct("year"), 100.0, 1e-9),
        Check("parts_equal_total", F.sum("reports"), o.select(F.count("*")).scalar()),
        Check("nations_with_reports", F.count_distinct("nation"), 25),
    ])
    return orders_checks.unionByName(share_checks).withColumn("actual", _r("actual"))


@query
def period_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-32: holes between consecutive published periods of each sender."""
    from veracity.operators.observations import drop_redundant
    from veracity.operators.quality import period_gaps as gaps
    facts = D.order_facts(spark, sf_dir, materialize=False)
    return gaps(drop_redundant(D.sender_observations(facts)))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosure records (one per sender) rebuilt from its observations."""
    from veracity.operators.observations import drop_redundant
    facts = D.order_facts(spark, sf_dir, materialize=False)
    obs = drop_redundant(D.sender_observations(facts)).withColumn("value", F.when(
        (F.col("period.label") == KNOCKOUT[0]) & (F.col("metric") == KNOCKOUT[1]), F.lit(None)
    ).otherwise(F.col("value")))
    rows = obs.groupBy("entity", F.col("period.label").alias("period")).agg(
        F.max(F.when(F.col("metric") == "reports", F.col("value"))).alias("reports"),
        F.max(F.when(F.col("metric") == "pieces", F.col("value"))).alias("pieces"),
    ).select("entity", F.struct(
        "period",
        F.array_compact(F.array(F.col("reports").cast("bigint").cast("string"),
                                F.col("pieces").cast("bigint").cast("string"))).alias("cells"),
    ).alias("row"))
    # One row per published period of an entity: bounded by its history.
    per_entity = rows.groupBy("entity").agg(F.collect_list("row").alias("rows"))
    nation = D.read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), "n_nationkey")
    quarterly = (F.col("n_nationkey") % 2) == 1
    return per_entity.join(F.broadcast(nation), "entity").select(
        "entity",
        F.array(F.lit("reports"), F.lit("pieces")).alias("columns"),
        F.create_map(F.lit("reports"), F.lit("int"), F.lit("pieces"), F.lit("int")).alias("schema"),
        "rows",
        F.when(quarterly, F.create_map(F.lit("total"), F.array(F.lit("reports"), F.lit("pieces"))))
        .otherwise(F.create_map(F.lit("total"), F.array(F.lit("reports"), F.lit("items")))).alias("sums"),
    )


@query
def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-31: cell counts, period labels, reserved names, types and rule sources."""
    from veracity.operators.quality import record_violations as violations
    return violations(_records(spark, sf_dir))


@query
def statement_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-33, S-11: enum, length, date and companion-text rules on statements."""
    from veracity.operators.quality import statement_violations as violations
    return violations(D.statements(spark, sf_dir))


@query
def territory_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-34: statements per territory and statements covering all of EU / EEA."""
    from veracity.operators.quality import territory_coverage as coverage
    return coverage(D.statements(spark, sf_dir))


@query
def term_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-14: category keywords exploded and counted."""
    st = D.statements(spark, sf_dir)
    return st.select(F.explode("category_specification").alias("keyword")).groupBy("keyword") \
        .agg(F.count("*").alias("statements"))


@query
def terms_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-14: each statement's keywords joined with '; '."""
    st = D.statements(spark, sf_dir)
    return st.select("uuid", F.concat_ws("; ", "category_specification").alias("terms"),
                     F.size("category_specification").alias("n_terms"))


@query
def survey_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-36, U-2: nations surveyed, with suppliers, disclosing (rich suppliers), silent."""
    from veracity.operators.quality import survey_counts as counts
    from veracity.sources.tables import read_table
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"), "n_nationkey")
    supplier = read_table(spark, sf_dir, "supplier").select("s_nationkey").distinct()
    firms = nation.join(supplier, nation["n_nationkey"] == supplier["s_nationkey"], "left_semi")
    disclosing = D.nations_with_rich_suppliers(spark, sf_dir, D.DENOMINATOR_BALANCE)
    return counts(nation, firms, disclosing, "nation")


# --------------------------------------------------------------------------
# Keys, lookups and sets


@query
def extreme_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-12: cheapest and dearest order per nation (ties -> smallest key)."""
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    # Extremes per customer first (skew-proof join), then per nation: min/max of
    # (price, key) structs is associative, so the two-level reduction is exact.
    per_customer = o.groupBy("o_custkey").agg(
        F.min(F.struct("o_totalprice", "o_orderkey")).alias("lo"),
        F.max(F.struct(F.col("o_totalprice"), (-F.col("o_orderkey")).alias("neg_key"))).alias("hi"))
    j = per_customer.join(c, per_customer["o_custkey"] == c["c_custkey"]) \
        .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupBy("nation").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return g.select("nation", F.col("lo.o_totalprice").alias("min_price"), F.col("lo.o_orderkey").alias("min_key"),
                    F.col("hi.o_totalprice").alias("max_price"), (-F.col("hi.neg_key")).alias("max_key"))


# Placeholder codes for one region, repairs by name, and cell
# overrides (a null override knocks the cell out).
PLACEHOLDER_REGION = "AFRICA"
REPAIRS = [("NATION_0", "N00"), ("NATION_5", "N05")]
OVERRIDES = [("NATION_1", 1996, None), ("NATION_2", 1997, 0)]


@query
def key_repair_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-13, P-14, P-15: placeholder codes repaired by name, cells overridden, defaults filled."""
    from veracity.operators.enrich import apply_overrides, repair_keys
    from veracity.sources.tables import read_table
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    codes = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_name").alias("nation"),
        F.when(F.col("r_name") == PLACEHOLDER_REGION, F.lit("-99"))
        .otherwise(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))).alias("code"))
    repairs = spark.createDataFrame(REPAIRS, "nation string, fixed string")
    codes = repair_keys(codes, repairs, "code", "nation", bounded=True)
    base = D.orders_by_nation_year(spark, sf_dir, materialize=False)
    overrides = spark.createDataFrame(OVERRIDES, "nation string, year int, new_value bigint")
    fixed = apply_overrides(base, overrides, ["nation", "year"], "reports", bounded=True)
    return fixed.join(F.broadcast(codes), "nation", "left") \
        .fillna({"code": "UNK", "reports": 0}) \
        .select("nation", "code", "year", "reports", "population")


@query
def scalar_base_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-17: each year's orders against the base year's, looked up once."""
    from veracity.sources.tables import read_table
    o = read_table(spark, sf_dir, "orders")
    y = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"))
    from veracity.operators.joins import unique_scalar
    base = unique_scalar(y.where(F.col("year") == D.BASE_YEAR), "orders")
    return y.select("year", "orders", base.alias("base")).withColumn(
        "pct_of_base", F.try_divide(F.col("orders").cast("double"), F.col("base").cast("double")) * 100.0)


def _units(x):
    return (F.when(F.col(x) >= 1_000_000, F.format_string("%.1fM", F.col(x) / 1_000_000.0))
            .when(F.col(x) >= 1_000, F.format_string("%.1fk", F.col(x) / 1_000.0))
            .otherwise(F.format_string("%d", F.col(x))))


@query
def label_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-18, F-13: tooltip labels with fixed precision and 0 / k / M units."""
    pc = _per_capita(spark, sf_dir)
    return pc.select("nation", "year", F.format_string(
        "%s:<br>%.5f (%s)", F.col("nation"), F.col("reports_per_capita"), _units("reports")).alias("label"))


# The two members shown side by side (R-9).
SIDE_BY_SIDE = ("NATION_1", "NATION_2")


@query
def brand_columns_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-9, J-6: two members' quarterly orders aligned on the quarter (full outer)."""
    from veracity.operators.reshape import side_by_side
    q = _quarterly(spark, sf_dir)
    return side_by_side({n: q.where(F.col("nation") == n) for n in SIDE_BY_SIDE}, ["qidx"], "orders")


@query
def key_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-2: nations with customers but no rich supplier, and the reverse."""
    from veracity.sources.tables import read_table
    nation = read_table(spark, sf_dir, "nation")
    customer = read_table(spark, sf_dir, "customer")
    keys = customer.select("c_nationkey").distinct()  # <= 25 rows per task before the shuffle
    with_cust = nation.join(keys, nation["n_nationkey"] == keys["c_nationkey"], "left_semi") \
        .select(F.col("n_name").alias("nation"))
    rich = D.nations_with_rich_suppliers(spark, sf_dir, D.DENOMINATOR_BALANCE)
    a = with_cust.join(rich, "nation", "left_anti").withColumn("side", F.lit("customers_only"))
    b = rich.join(with_cust, "nation", "left_anti").withColumn("side", F.lit("suppliers_only"))
    return a.unionByName(b)


@query
def ownership_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-3, U-4: each owner's brands and former names as one distinct set."""
    own = D.ownership(spark, sf_dir)
    aka = own.select("owner", F.initcap("owner").alias("member")).distinct()
    return own.select("owner", "member").unionByName(aka).distinct()


# --------------------------------------------------------------------------
# Computed columns


def _line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations per (return flag, ship quarter): qty, lines, gross, tax (cents)."""
    from veracity.functions.periods import period_of_date
    from veracity.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_returnflag").alias("entity"), period_of_date("l_shipdate", "Q").alias("period")).agg(
        F.sum("l_quantity").alias("qty"), F.count("*").cast("double").alias("lines"),
        F.sum(F.round(F.col("l_extendedprice") * 100)).alias("gross"),
        F.sum(F.round(F.col("l_extendedprice") * F.col("l_tax") * 100)).alias("tax"))
    return g.unpivot(["entity", "period"], ["qty", "lines", "gross", "tax"], "metric", "value") \
        .withColumn("observer", F.lit("sender"))


# Computed-column rules (kind, target, sources).
SUM_RULES = [("sums", "charge", "gross"), ("sums", "charge", "tax"), ("sums", "tax", "qty")]
PRODUCT_RULES = [("products", "volume", "qty"), ("products", "volume", "lines")]


def _computed(spark: SparkSession, sf_dir: str, rules) -> DataFrame:
    from veracity.operators.rollup import computed_columns
    obs = _line_metrics(spark, sf_dir)
    r = spark.createDataFrame(rules, "kind string, target string, source string")
    out = computed_columns(obs, r, bounded_rules=True)
    return out.select("entity", F.col("period.label").alias("label"), "metric", "value")


@query
def computed_columns_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-3: sum rules; a rule onto a published metric adds with fill 0."""
    return _computed(spark, sf_dir, SUM_RULES)


@query
def computed_columns_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-3: product rules over non-null sources."""
    return _computed(spark, sf_dir, PRODUCT_RULES)


# --------------------------------------------------------------------------
# Sources and sinks, written to the shared scratch folder and read back


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-1, S-5, S-6, K-1, K-3: counts with thousands separators and a literal 'NA'
    code written as CSV with a fixed column order, then scanned back typed."""
    from veracity.sources.csv import read_counts_csv
    from veracity.sources.sinks import scratch_path, write_csv
    base = D.orders_by_nation_year(spark, sf_dir, materialize=False)
    out = base.select(
        "nation",
        F.when(F.col("nation") == "NATION_0", F.lit("NA"))
        .otherwise(F.concat(F.lit("N"), F.regexp_extract("nation", r"(\d+)$", 1))).alias("code"),
        F.col("year").cast("string").alias("year"),
        F.format_number("reports", 0).alias("reports"),
        F.format_number("population", 0).alias("population"),
    )
    path = scratch_path(spark, "csv")
    cols = ["nation", "code", "year", "reports", "population"]
    write_csv(out, path, cols)
    back = read_counts_csv(spark, path, cols, ["reports", "population"])
    return back.withColumn("year", F.col("year").cast("int"))


@query
def json_collection_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-2, S-10: sender disclosures exported as nested records and re-ingested."""
    from veracity.sources.disclosures import observations_of, read_collection, to_collection_lines
    from veracity.sources.sinks import scratch_path, write_text_lines
    facts = D.order_facts(spark, sf_dir, materialize=False)
    lines = to_collection_lines(D.sender_observations(facts), ["reports", "pieces"])
    path = scratch_path(spark, "json")
    write_text_lines(lines, path)
    obs = observations_of(read_collection(spark, path))
    return obs.select("entity", "observer", F.col("period.label").alias("label"),
                      F.col("period.year").alias("year"), "metric", "value", "redundant")


@query
def snapshot_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-7, S-8, F-4: one CSV folder per snapshot, snapshot ids parsed from the paths."""
    from veracity.functions.periods import index_quarter, index_year
    from veracity.sources.csv import read_snapshots
    from veracity.sources.sinks import scratch_path, write_csv
    snaps = D.revenue_snapshots(spark, sf_dir).withColumn(
        "file", F.format_string("rev-%04d-q%d", index_year("snapshot"), index_quarter("snapshot")))
    path = scratch_path(spark, "snapshots")
    cols = ["nation", "priority", "status", "period", "cents"]
    write_csv(snaps, path, cols, partition_by=["file"])
    back = read_snapshots(spark, path, cols, r"rev-(\d{4})-q(\d)")
    return back.select("nation", "priority", "status", F.col("period").cast("int").alias("period"),
                       "snapshot", F.col("cents").cast("bigint").alias("cents"))


# --------------------------------------------------------------------------
# Streaming


@query
def snapshot_stream_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-4 incrementally: snapshot files streamed a few per micro-batch
    through the restatement monitor; must equal the batch diff."""
    from veracity.functions.periods import index_quarter, index_year
    from veracity.sources.sinks import scratch_path, write_csv
    from veracity.streaming import read_restatements, restatement_monitor
    snaps = D.revenue_snapshots(spark, sf_dir).withColumn(
        "file", F.format_string("rev-%04d-q%d", index_year("snapshot"), index_quarter("snapshot")))
    base = scratch_path(spark, "stream")
    cols = ["nation", "priority", "status", "period", "cents"]
    # One file per snapshot: a snapshot never straddles two micro-batches.
    write_csv(snaps.repartition("file"), f"{base}/in", cols, partition_by=["file"])
    q = restatement_monitor(
        spark, f"{base}/in", cols, {"period": "int", "cents": "bigint"}, r"rev-(\d{4})-q(\d)",
        list(D.SNAPSHOT_KEYS), "cents", f"{base}/history", f"{base}/diffs", f"{base}/checkpoint",
        files_per_batch=5)
    q.awaitTermination()
    return read_restatements(spark, f"{base}/diffs", list(D.SNAPSHOT_KEYS), {"period": "int", "cents": "bigint"},
                             "cents").select("snapshot", "nation", "priority", "status", "period",
                                             "value_before", "value_after")


# The variant and sex codes kept from the pipe-separated batches
# (the population scan keeps one projection variant and both sexes).
KEEP_VARIANT, KEEP_SEX = 4, 3


@query
def pipe_batches_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-3, S-4, P-6: nation-year denominators written as '|'-separated batches,
    each opening with a 'sep=|' preamble and a header, read back pruned and typed."""
    from veracity.sources.csv import read_with_preamble, type_subset
    from veracity.sources.sinks import scratch_path, write_text_lines
    base = D.orders_by_nation_year(spark, sf_dir)
    cols = ["Iso3", "VariantId", "TimeLabel", "SexId", "Value", "Note"]
    variants = F.explode(F.array(
        F.struct(F.lit(KEEP_VARIANT).alias("v"), F.lit(KEEP_SEX).alias("s"), F.col("population").alias("x")),
        F.struct(F.lit(2).alias("v"), F.lit(KEEP_SEX).alias("s"), (F.col("population") * 2).alias("x")),
        F.struct(F.lit(KEEP_VARIANT).alias("v"), F.lit(1).alias("s"), F.col("reports").alias("x")),
    ))
    rows = base.select("nation", "year", variants.alias("r")).select(
        F.col("year").alias("batch"), F.lit(2).alias("line"),
        F.concat_ws("|", "nation", F.col("r.v").cast("string"), F.col("year").cast("string"),
                    F.col("r.s").cast("string"), F.col("r.x").cast("string"), F.lit("n/a")).alias("value"))
    # One batch per year: its preamble and header lead its lines in the file.
    heads = base.select(F.col("year").alias("batch")).distinct().select(
        "batch", F.explode(F.array(
            F.struct(F.lit(0).alias("line"), F.lit("sep=|").alias("value")),
            F.struct(F.lit(1).alias("line"), F.lit("|".join(cols)).alias("value")))).alias("h")
    ).select("batch", "h.line", "h.value")
    path = scratch_path(spark, "pipe")
    write_text_lines(rows.unionByName(heads).repartition("batch").sortWithinPartitions("batch", "line")
                     .select("value"), path)
    raw = read_with_preamble(spark, path, cols)
    t = type_subset(raw, {"Iso3": "string", "VariantId": "int", "TimeLabel": "int", "SexId": "int", "Value": "bigint"})
    return t.where((F.col("VariantId") == KEEP_VARIANT) & (F.col("SexId") == KEEP_SEX)).select(
        F.col("Iso3").alias("nation"), F.col("TimeLabel").alias("year"), F.col("Value").alias("population"))


@query
def converters_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-9, F-11, F-18: a CSV with capitalised headers and mixed-case categories,
    read with lower-cased headers, case-folded values and 3-significant-digit numbers."""
    from veracity.sources.csv import read_with_converters
    from veracity.sources.sinks import scratch_path, write_csv
    o = D.read_table(spark, sf_dir, "orders").groupBy(
        F.year("o_orderdate").alias("Year"), F.initcap("o_orderpriority").alias("Priority")
    ).agg(F.sum("o_totalprice").alias("Total"))
    path = scratch_path(spark, "conv")
    cols = ["Year", "Priority", "Total"]
    write_csv(o.select(F.col("Year").cast("string"), "Priority",
                       F.format_number("Total", 2).alias("Total")), path, cols)
    back = read_with_converters(spark, path, cols, casefold=["Priority"], significant={"Total": 3})
    return back.select(F.col("year").cast("int").alias("year"), "priority", F.col("total").alias("total_3sig"))


@query
def disclosure_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-5, F-14, K-2, S-10: each sender's profile (granularity, terms) exported
    inside its record and read back as one feature row per entity."""
    from veracity.operators.observations import drop_redundant
    from veracity.sources.disclosures import features_of, read_collection, to_collection_lines
    from veracity.sources.sinks import scratch_path, write_text_lines
    facts = D.order_facts(spark, sf_dir)
    obs = D.sender_observations(facts)
    published = drop_redundant(obs)
    profile = published.groupBy("entity").agg(
        F.max(F.col("period.freq")).alias("_freq"),
        F.array_sort(F.collect_set("metric")).alias("_terms"))  # bounded: metric names
    feats = profile.select("entity", F.struct(
        F.lit("counts").alias("data"), F.lit("yearly totals restated").alias("history"),
        F.col("_terms").alias("terms"), F.lit("orders").alias("quantities"),
        F.when(F.col("_freq") == "Q", F.lit("quarterly")).otherwise(F.lit("half-yearly")).alias("granularity"),
        F.lit("continuous").alias("frequency"), F.lit("all nations").alias("coverage"),
    ).alias("features"))
    path = scratch_path(spark, "features")
    write_text_lines(to_collection_lines(obs, ["reports", "pieces"], feats), path)
    return features_of(read_collection(spark, path)).select("entity", "granularity", "terms", "has_reports")


# The two levels placed above the regions in the hierarchy.
TOP_LEVELS = ("WORLD", "GLOBE")


@query
def country_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SURVEY 3.1 end to end (R-1, P-15, A-1, A-15, J-1, J-2, J-3, J-7, F-20, A-17):
    order counts pivoted to year columns, then melted, shared, joined to
    customer denominators, dimensions and a three-level hierarchy, with the
    league's summary row per year."""
    from veracity.plans.country import reports_per_country
    from veracity.sources.tables import read_table
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    # One row per (customer, year) first: skew-proof customer join.
    per_customer = orders.groupBy("o_custkey", "year").agg(F.count("*").alias("n"))
    joined = per_customer.join(customer, per_customer["o_custkey"] == customer["c_custkey"]) \
        .join(F.broadcast(nation.select("n_nationkey", F.col("n_name").alias("iso3"))),
              F.col("c_nationkey") == F.col("n_nationkey"))
    per_cell = joined.groupBy("iso3", "year").agg(
        F.sum("n").alias("reports"), F.count("*").alias("population"),
        F.count_if(F.col("c_acctbal") > 0).alias("online"))
    # Spark discovers the year columns of the wide table itself.
    wide = per_cell.groupBy("iso3").pivot("year").agg(F.sum("reports"))
    years = [c for c in wide.columns if c != "iso3"]
    countries = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_name").alias("iso3"), F.lower("n_name").alias("country"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iso2"), F.col("r_name").alias("region"))
    regions = region.select(F.lit(TOP_LEVELS[0]).alias("superregion"), F.col("r_name").alias("region")).unionByName(
        spark.createDataFrame([TOP_LEVELS[::-1]], "superregion string, region string"))
    league = D.nations_with_rich_suppliers(spark, sf_dir, D.LEAGUE_BALANCE).select(F.col("nation").alias("iso3"))
    out = reports_per_country(
        wide.select("iso3", *[F.col(f"`{y}`").cast("string").alias(y) for y in years]),
        per_cell.select("iso3", "year", "population"), per_cell.select("iso3", "year", "online"),
        countries, regions, league, years)
    return out.withColumn("reports_pct", _r("reports_pct")).withColumn("population_pct", _r("population_pct"))
