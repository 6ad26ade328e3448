"""The driver's TPC-H-like tables seen as disclosure data.

Domain mapping used by every query in the catalogue:

* ownership: region = owner, nation = member (a two-level tree);
* the *sender* is the nation itself, publishing per period the number of
  orders it placed (``reports``) and their line items (``pieces``); odd
  nations publish quarterly, even nations half-yearly, and every nation
  also publishes a yearly total that is flagged ``redundant``;
* the *receiver* counts, per nation and year, the orders it actually saw
  in ``lineitem`` (orders with at least one line);
* ``esp`` is the receiver's total over all nations and ``total`` the
  number of all orders in a year.

The heavy steps reduce before they shuffle: line items to one row per
order (or per order and ship quarter), orders to one row per customer and
period before the customer join (so a customer holding a third of all
orders cannot skew it), then to one row per (nation, period).  Everything
after that works on a few thousand rows per year of history, whatever the
size of ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.functions.periods import make_period
from veracity.operators.joins import dim_join
from veracity.session import cut_lineage
from veracity.sources.tables import read_table


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(owner, member, relation)``: nations (members) of regions (owners)."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return (
        dim_join(nation, region, nation["n_regionkey"] == region["r_regionkey"], "inner", bounded=True)
        .select(F.col("r_name").alias("owner"), F.col("n_name").alias("member"),
                F.lit("brand").alias("relation"))
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order key that has line items: ``(l_orderkey, lines)``."""
    return read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


def order_facts(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Orders per (nation, year, quarter): all, seen by the receiver, lines.

    ``(n_nationkey, n_name, year, quarter, orders, seen, lines)``.  Plans that
    read it once pass ``materialize=False`` and skip the stage table.
    """
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = order_lines(spark, sf_dir)
    per_order = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    # Aggregate to the customer key before joining customers: a customer
    # holding a third of all orders reaches the join as one row per quarter.
    per_customer = per_order.groupBy(
        "o_custkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"),
    ).agg(F.count("*").alias("orders"), F.count("l_orderkey").alias("seen"), F.sum("lines").alias("lines"))
    per_cell = per_customer.join(customer, per_customer["o_custkey"] == customer["c_custkey"], "inner") \
        .groupBy("c_nationkey", "year", "quarter").agg(
            F.sum("orders").alias("orders"), F.sum("seen").alias("seen"), F.sum("lines").alias("lines"))
    facts = dim_join(per_cell, nation, per_cell["c_nationkey"] == nation["n_nationkey"], "inner", bounded=True) \
        .select("n_nationkey", "n_name", "year", "quarter", "orders", "seen", "lines")
    # Every audit reads this small aggregate several times (sender, receiver,
    # totals, spine bounds): materialise it once in the shared checkpoint
    # folder so the scan of lineitem/orders runs once and lineage is cut.
    return cut_lineage(facts) if materialize else facts


def sender_observations(facts: DataFrame) -> DataFrame:
    """The nations' own disclosures at mixed granularity plus redundant totals."""
    is_quarterly = (F.col("n_nationkey") % 2) == 1
    freq = F.when(is_quarterly, F.lit("Q")).otherwise(F.lit("H"))
    part = F.when(is_quarterly, F.col("quarter")).otherwise(F.floor((F.col("quarter") - 1) / 2) + 1)
    # Periodic rows and the redundant yearly totals come from one aggregate:
    # each fact row is emitted twice (its own period, its year) and summed.
    both_grains = F.explode(F.array(
        F.struct(freq.alias("freq"), part.alias("part"), F.lit(False).alias("redundant")),
        F.struct(F.lit("Y").alias("freq"), F.lit(1).alias("part"), F.lit(True).alias("redundant")),
    ))
    rows = facts.select(F.col("n_name").alias("entity"), "year", "orders", "lines", both_grains.alias("g")) \
        .groupBy("entity", "year", "g").agg(F.sum("orders").cast("double").alias("reports"),
                                            F.sum("lines").cast("double").alias("pieces"))
    metrics = F.explode(F.array(
        F.struct(F.lit("reports").alias("metric"), F.col("reports").alias("value")),
        F.struct(F.lit("pieces").alias("metric"), F.col("pieces").alias("value")),
    ))
    return rows.select(
        "entity", "year", F.col("g.freq").alias("freq"), F.col("g.part").alias("part"),
        metrics.alias("m"), F.col("g.redundant").alias("redundant"),
    ).select("entity", F.lit("sender").alias("observer"), make_period("year", "freq", "part").alias("period"),
             F.col("m.metric").alias("metric"), F.col("m.value").alias("value"), "redundant")


def receiver_observations(facts: DataFrame) -> DataFrame:
    """The receiver's yearly count per nation."""
    return (
        facts.groupBy(F.col("n_name").alias("entity"), "year")
        .agg(F.sum("seen").cast("double").alias("value"))
        .select("entity", F.lit("receiver").alias("observer"),
                make_period("year", "Y", 1).alias("period"),
                F.lit("reports").alias("metric"), "value", F.lit(False).alias("redundant"))
    )


def yearly_totals(facts: DataFrame) -> DataFrame:
    """``(year, esp, total)``: receiver's industry total and all orders."""
    return facts.groupBy("year").agg(
        F.sum("seen").alias("esp"), F.sum("orders").alias("total")
    )


def revenue_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue (integer cents) per (nation, priority, status, order quarter,
    ship quarter): what became known about an order quarter at each
    quarter.  The line items are reduced by this aggregate before anything
    else touches them; the output is bounded by keys x quarters x quarters.
    """
    from veracity.functions.periods import quarter_index_of_date
    # Pre-aggregate lines per (order, ship quarter) before the join: an order's
    # lines mostly ship within a quarter or two, so far fewer rows are shuffled.
    lineitem = read_table(spark, sf_dir, "lineitem").groupBy(
        "l_orderkey", quarter_index_of_date("l_shipdate").alias("known_at")
    ).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("line_cents"))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_order = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"], "inner")
    # Reduce to the customer key first so a hot customer cannot skew the join.
    per_customer = per_order.groupBy(
        "o_custkey", "o_orderpriority", "o_orderstatus",
        quarter_index_of_date("o_orderdate").alias("period"), "known_at",
    ).agg(F.sum("line_cents").alias("line_cents"))
    joined = per_customer.join(customer, per_customer["o_custkey"] == customer["c_custkey"], "inner")
    joined = dim_join(joined, nation, joined["c_nationkey"] == nation["n_nationkey"], "inner", bounded=True)
    inc = joined.groupBy(
        F.col("n_name").alias("nation"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        "period",
        "known_at",
    ).agg(F.sum("line_cents").alias("cents"))
    # Bounded by keys x quarters x quarters; read again by the snapshot grid
    # and its bounds, so it is materialised once.
    return cut_lineage(inc)


SNAPSHOT_KEYS = ("nation", "priority", "status", "period")


def revenue_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(nation, priority, status, period, snapshot, cents)``: every quarter's
    restatement of the revenue history."""
    from veracity.operators.revisions import snapshots_from_increments
    inc = revenue_increments(spark, sf_dir)
    return snapshots_from_increments(inc, ["nation", "priority", "status"], "period", "known_at", "cents")


def orders_by_nation_year(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """``(nation, year, reports, population)``: orders placed and the number
    of distinct customers who ordered (the denominator), per nation and year."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # One row per (customer, year) before the customer join (skew-proof); a
    # nation-year's distinct customers are then just its rows.
    per_customer = orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")) \
        .agg(F.count("*").alias("reports"))
    per = per_customer.join(customer, per_customer["o_custkey"] == customer["c_custkey"], "inner") \
        .groupBy("c_nationkey", "year") \
        .agg(F.sum("reports").alias("reports"), F.count("*").alias("population"))
    out = dim_join(per, nation, per["c_nationkey"] == nation["n_nationkey"], "inner", bounded=True) \
        .select(F.col("n_name").alias("nation"), "year", "reports", "population")
    # Nations x years rows, read by several branches (facts, denominators,
    # shares): computed once so orders and customers are scanned once.
    return cut_lineage(out, "nation-year") if materialize else out


# Account-balance thresholds that define the league (suppliers
# above 5,000) and the denominator used for the missing-denominator audit
# (suppliers above 8,000).
LEAGUE_BALANCE = 5000.0
DENOMINATOR_BALANCE = 8000.0


def nations_with_rich_suppliers(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    """``(nation)`` of nations having a supplier with balance above ``threshold``."""
    # Distinct keys first: the supplier side shrinks to <= 25 rows per task
    # before it is shuffled or broadcast for the semi-join.
    supplier = read_table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > threshold) \
        .select("s_nationkey").distinct()
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return nation.join(supplier, nation["n_nationkey"] == supplier["s_nationkey"], "left_semi") \
        .select(F.col("n_name").alias("nation"))


def nation_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(nation, region, online)``: region name and customers with a positive balance."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    customer = read_table(spark, sf_dir, "customer")
    online = customer.groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("online"))
    dims = dim_join(nation, region, nation["n_regionkey"] == region["r_regionkey"], "left", bounded=True)
    return dims.join(online, dims["n_nationkey"] == online["c_nationkey"], "left") \
        .select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "online")


def orders_by_nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(nation, year, month, x, orders)`` with ``x`` months since the base year."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_customer = orders.groupBy("o_custkey", F.year("o_orderdate").alias("year"),
                                  F.month("o_orderdate").alias("month")).agg(F.count("*").alias("orders"))
    per = per_customer.join(customer, per_customer["o_custkey"] == customer["c_custkey"], "inner") \
        .groupBy("c_nationkey", "year", "month").agg(F.sum("orders").alias("orders"))
    per = dim_join(per, nation, per["c_nationkey"] == nation["n_nationkey"], "inner", bounded=True)
    return per.select(F.col("n_name").alias("nation"), "year", "month",
                      ((F.col("year") - BASE_YEAR) * 12 + F.col("month") - 1).alias("x"), "orders")


# Fixed value: the base year for growth and month numbering.
BASE_YEAR = 1995


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of reasons derived from ``documents`` and ``labels`` (S-11).

    The whole document text is the statement's facts; labels drive the
    decision, ground and category; text length dates the content and the
    decision.  Unknown enum values, over-long texts and too-early dates
    occur naturally and are what :func:`statement_violations` finds.
    """
    from veracity.sources import statements as S
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = docs.join(labels, "doc_id", "left")
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    low = F.col("quality") == 0
    labelled = F.col("quality").isNotNull()

    from veracity.operators.quality import lit_array as arr

    empty = F.array().cast("array<string>")
    out = d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("uuid"),
        F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), F.lit(0))).alias("created_at"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("puid"),
        F.when(F.col("lang") == "en", "CONTENT_TYPE_TEXT").when(F.col("lang") == "fr", "CONTENT_TYPE_VIDEO")
        .when(F.col("lang") == "de", "CONTENT_TYPE_IMAGE").otherwise("CONTENT_TYPE_SCRIPT").alias("content_type"),
        F.lit(None).cast("string").alias("content_type_other"),
        F.date_add(F.lit("1999-12-01").cast("date"), (F.col("n_chars") / 10).cast("int")).alias("content_date"),
        F.upper("lang").alias("content_language"),
        F.when(toxic, arr(["DECISION_VISIBILITY_CONTENT_REMOVED"]))
        .when(low, arr(["DECISION_VISIBILITY_CONTENT_DEMOTED"]))
        .when(labelled, arr(["DECISION_VISIBILITY_CONTENT_LABELLED"])).otherwise(empty).alias("decision_visibility"),
        F.lit(None).cast("string").alias("decision_visibility_other"),
        F.lit(None).cast("string").alias("decision_monetary"),
        F.lit(None).cast("string").alias("decision_monetary_other"),
        F.lit(None).cast("string").alias("decision_provision"),
        F.when(toxic & low, F.lit("DECISION_ACCOUNT_SUSPENDED")).alias("decision_account"),
        F.date_add(F.lit("2019-12-15").cast("date"), (F.col("n_chars") / 20).cast("int")).alias("application_date"),
        *[F.lit(None).cast("date").alias(c) for c in (
            "end_date_visibility_restriction", "end_date_monetary_restriction",
            "end_date_service_restriction", "end_date_account_restriction")],
        F.when(F.col("lang") == "en", arr(S.EEA)).when(F.col("lang") == "fr", arr(S.EU))
        .when(F.col("lang") == "de", arr([*S.EU, "CH"])).otherwise(arr(["ES", "PT"])).alias("territorial_scope"),
        F.col("text").alias("decision_facts"),
        F.when(labelled, F.lit("SOURCE_TRUSTED_FLAGGER")).otherwise(F.lit("SOURCE_VOLUNTARY")).alias("source_type"),
        F.lit(None).cast("string").alias("source_identity"),
        F.lit(None).cast("string").alias("account_type"),
        toxic.alias("automated_detection"),
        F.when(toxic, F.lit("AUTOMATED_DECISION_FULLY")).otherwise(F.lit("AUTOMATED_DECISION_NOT_AUTOMATED"))
        .alias("automated_decision"),
        F.when(toxic, F.lit("DECISION_GROUND_ILLEGAL_CONTENT"))
        .otherwise(F.lit("DECISION_GROUND_INCOMPATIBLE_CONTENT")).alias("decision_ground"),
        F.when(toxic & (F.col("quality") == 1), F.lit("Article 2")).alias("illegal_content_legal_ground"),
        F.lit(None).cast("string").alias("illegal_content_explanation"),
        F.when(~toxic & labelled, F.lit("Terms of service")).alias("incompatible_content_ground"),
        F.lit(None).cast("string").alias("incompatible_content_explanation"),
        F.lit(None).cast("boolean").alias("incompatible_content_illegal"),
        F.lit(None).cast("string").alias("decision_ground_reference_url"),
        F.when(toxic, F.lit("STATEMENT_CATEGORY_ILLEGAL_OR_HARMFUL_SPEECH"))
        .when(low, F.lit("STATEMENT_CATEGORY_SCOPE_OF_PLATFORM_SERVICE"))
        .when(labelled, F.lit("STATEMENT_CATEGORY_SCAMS_AND_FRAUD"))
        .otherwise(F.lit("STATEMENT_CATEGORY_OTHER")).alias("category"),
        empty.alias("category_addition"),
        F.when(toxic, arr(["KEYWORD_HATE_SPEECH", "KEYWORD_DEFAMATION"]))
        .when(low, arr(["KEYWORD_OTHER"])).otherwise(empty).alias("category_specification"),
        F.lit(None).cast("string").alias("category_specification_other"),
    )
    return out
