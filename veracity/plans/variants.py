"""Queries over the variants of operators that the main catalogue leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.plans import domain as D
from veracity.plans import oracle as O
from veracity.sources.sinks import scratch_path, write_csv
from veracity.sources.tables import read_table

# The owner left out of the audit, and the share that a priority must pass to be shown.
EXCLUDED = "AFRICA"
SHARE_ABOVE = 20.0


def typed_subset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-2, S-4: three typed columns of a '|'-separated file of five."""
    from veracity.sources.csv import read_typed_subset
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    path = scratch_path(spark, "customers")
    write_csv(read_table(spark, sf_dir, "customer"), path, cols, sep="|")
    return read_typed_subset(spark, path, cols, {"c_custkey": "bigint", "c_acctbal": "double", "c_mktsegment": "string"}, sep="|")


def conformed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-2: orders per year and status in a fixed column order; a status that never occurs is a null column."""
    from veracity.operators.observations import conform_columns
    o = read_table(spark, sf_dir, "orders")
    wide = o.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("F"), F.count_if(F.col("o_orderstatus") == "O").alias("O"))
    return conform_columns(wide, ["O", "X", "year", "F"], "bigint")


def fill_zero_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-4: cheap orders per customer added to dear ones; a side without the customer counts as 0."""
    from veracity.operators.rollup import add_fill_zero
    o = read_table(spark, sf_dir, "orders")

    def per_customer(rows):
        return rows.groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") != "P", 1.0)).alias("value"))

    return add_fill_zero(per_customer(o.where("o_totalprice < 100000")), per_customer(o.where("o_totalprice >= 300000")), ["o_custkey"])


def named_without_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-8: the customers who ordered in a year without an account balance above zero, by name."""
    from veracity.operators.enrich import keys_without_denominator
    o = read_table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"))
    rich = read_table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return keys_without_denominator(o, rich, ["o_custkey"], ["year"], "orders")


def top_share_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18: shares of the priorities above the threshold and the others per year, a column each, 0 where a
    year has none."""
    from veracity.operators.trends import top_shares_wide
    o = read_table(spark, sf_dir, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"))
    labels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = top_shares_wide(o, "priority", "orders", ["year"], SHARE_ABOVE, labels)
    return wide.select("year", *[F.round(F.col(f"`{c}`"), 9).alias(f"share_{n}") for n, c in enumerate([*labels, "Others"])])


def audit_without_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-27: the audit of all entities but an excluded one."""
    from veracity.operators import audit as A
    facts = D.order_facts(spark, sf_dir)
    return A.audit_observers(D.sender_observations(facts), D.receiver_observations(facts), D.ownership(spark, sf_dir),
                             D.yearly_totals(facts), exclude=(EXCLUDED,), bounded_ownership=True)


def customer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-32: quarters without an order between a customer's quarters with orders."""
    from veracity.functions.periods import period_of_date
    from veracity.operators.quality import period_gaps
    obs = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), period_of_date("o_orderdate", "Q").alias("period"))
    return period_gaps(obs)


def comparable_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-28, first view: comparable counts by the names of both observers, with their topic."""
    from veracity.operators.audit import comparable_by_provider as view
    return view(_audit(spark, sf_dir), "Receiver")


def comparable_anonymous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-28, second view: the same counts without the sender's name in observer and topic."""
    from veracity.operators.audit import comparable_anonymous as view, comparable_by_provider as named
    return view(named(_audit(spark, sf_dir), "Receiver"), "Receiver")


def fit_mse_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-13: mean squared error of the line, the exponential and the weighted exponential fit, and
    each as a factor of the line's."""
    from veracity.operators.trends import exp_fit, linear_fit, mse_factors
    m = D.orders_by_nation_month(spark, sf_dir)
    ex = exp_fit(m, ["nation"], "x", "orders")
    wex = exp_fit(m, ["nation"], "x", "orders", weighted=True).withColumnsRenamed({"rate": "w_rate", "log_scale": "w_scale"})
    fitted = m.join(linear_fit(m, ["nation"], "x", "orders"), "nation").join(ex, "nation").join(wex, "nation").select(
        "nation", "orders", F.expr("intercept + slope * x").alias("linear"), F.expr("exp(log_scale + rate * x)").alias("exponential"),
        F.expr("exp(w_scale + w_rate * x)").alias("weighted"))
    out = mse_factors(fitted, ["nation"], "orders", ["linear", "exponential", "weighted"], "linear")
    return out.select("nation", "model", F.round("mse", 6).alias("mse"), F.round("factor", 6).alias("factor"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veracity.operators import audit as A
    facts = D.order_facts(spark, sf_dir)
    return A.audit_observers(D.sender_observations(facts), D.receiver_observations(facts), D.ownership(spark, sf_dir),
                             D.yearly_totals(facts), bounded_ownership=True)


QUERIES = {f.__name__: f for f in (comparable_by_provider, comparable_anonymous, fit_mse_factors, typed_subset_scan, conformed_columns, fill_zero_addition, named_without_denominator,
                                   top_share_wide, audit_without_owner, customer_gaps)}

_COMPARABLE = O.AUDIT + """, named AS (
  SELECT year, entity AS observer, CAST(reports AS BIGINT) AS count, entity AS topic FROM audit
  WHERE reports IS NOT NULL AND received IS NOT NULL
  UNION ALL SELECT year, 'Receiver', CAST(received AS BIGINT), entity FROM audit WHERE reports IS NOT NULL AND received IS NOT NULL)
"""

ORACLE = {
    "comparable_by_provider": _COMPARABLE + "SELECT * FROM named",
    "comparable_anonymous": _COMPARABLE + """
SELECT topic || CAST(year AS VARCHAR) AS id, year, CASE observer WHEN 'Receiver' THEN 'Receiver' ELSE 'ServiceProvider' END AS observer,
       count FROM named""",
    "fit_mse_factors": O.TR + """
, e AS (
  SELECT m.nation, avg(pow(CAST(orders AS DOUBLE) - (l.intercept + l.slope * m.x), 2)) AS linear,
         avg(pow(CAST(orders AS DOUBLE) - exp(e.log_scale + e.rate * m.x), 2)) AS exponential,
         avg(pow(CAST(orders AS DOUBLE) - exp((w.swz - w.rate * w.swx) / w.sw + w.rate * m.x), 2)) AS weighted
  FROM mx m JOIN lin l ON m.nation = l.nation JOIN ex e ON m.nation = e.nation JOIN wex w ON m.nation = w.nation GROUP BY 1
)
SELECT nation, 'linear' AS model, round(linear, 6) AS mse, round(linear / linear, 6) AS factor FROM e
UNION ALL SELECT nation, 'exponential', round(exponential, 6), round(exponential / linear, 6) FROM e
UNION ALL SELECT nation, 'weighted', round(weighted, 6), round(weighted / linear, 6) FROM e""",
    "typed_subset_scan": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
    "conformed_columns": """
SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", CAST(NULL AS BIGINT) AS "X", CAST(year(o_orderdate) AS INTEGER) AS year,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS "F" FROM orders GROUP BY 3""",
    "fill_zero_addition": """
SELECT o_custkey, sum(CASE WHEN o_orderstatus <> 'P' THEN 1.0::DOUBLE END) AS value
FROM orders WHERE o_totalprice < 100000 OR o_totalprice >= 300000 GROUP BY 1""",
    "named_without_denominator": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey, count(*) AS orders
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY ALL""",
    "top_share_wide": """
WITH n AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT year, p, 100.0 * n / sum(n) OVER (PARTITION BY year) AS s FROM n),
k AS (SELECT * FROM s WHERE s > 20)
SELECT year, round(coalesce(max(s) FILTER (WHERE p = '1-URGENT'), 0), 9) AS share_0, round(coalesce(max(s) FILTER (WHERE p = '2-HIGH'), 0), 9) AS share_1,
       round(coalesce(max(s) FILTER (WHERE p = '3-MEDIUM'), 0), 9) AS share_2,
       round(coalesce(max(s) FILTER (WHERE p = '4-NOT SPECIFIED'), 0), 9) AS share_3,
       round(coalesce(max(s) FILTER (WHERE p = '5-LOW'), 0), 9) AS share_4, round(100 - sum(s), 9) AS share_5
FROM k GROUP BY year""",
    "audit_without_owner": f"SELECT * FROM ({O.ORACLE['audit_by_region_year']}) WHERE entity <> '{EXCLUDED}'",
    "customer_gaps": """
WITH q AS (SELECT DISTINCT o_custkey AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS s FROM orders),
n AS (SELECT entity, s, lead(s) OVER (PARTITION BY entity ORDER BY s) AS nx FROM q)
SELECT entity, concat(year(s), ' Q', quarter(s)) AS label, concat(year(nx), ' Q', quarter(nx)) AS next_label,
       CAST(nx - (s + INTERVAL 3 MONTH)::DATE AS INTEGER) AS gap_days
FROM n WHERE nx > s + INTERVAL 3 MONTH""",
}
