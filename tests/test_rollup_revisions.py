import datetime as dt

from pyspark.sql import functions as F

from veracity.functions.periods import parse_period
from veracity.operators.observations import drop_redundant, observations
from veracity.operators.revisions import diff_snapshots, divergence_age, divergence_rate, snapshots_from_increments
from veracity.operators.rollup import (add_fill_zero, annualize, annualize_strict, computed_columns, rollup,
                                       row_sum)

ROWS = [
    # entity, label, reports, pieces, redundant
    ("Q", "2020 Q1", 1.0, 10.0, False), ("Q", "2020 Q2", 2.0, None, False),
    ("Q", "2020 Q3", 3.0, 30.0, False), ("Q", "2020 Q4", 4.0, 40.0, False),
    ("Q", "2020", 99.0, 99.0, True),                       # redundant total that disagrees
    ("H", "2021 H1", 5.0, 50.0, False),                    # a year covered by H1 only
    ("M", "2022 Q1", 1.0, None, False), ("M", "2022 Q2", 1.0, None, False),
    ("M", "2022 H2", None, 7.0, False),                    # Q rows and H rows with disjoint metrics
]


def _obs(spark):
    df = spark.createDataFrame(ROWS, "entity string, label string, reports double, pieces double, redundant boolean")
    return observations(df.withColumn("p", parse_period("label")), "entity", "sender", "p",
                        ["reports", "pieces"], "redundant")


def _by(df):
    return {(r.entity, r.metric): r.value for r in df.collect()}


def test_annualize_drops_partial_years_and_redundant(spark):
    out = _by(annualize(drop_redundant(_obs(spark))))
    assert out[("Q", "reports")] == 10.0
    assert out[("Q", "pieces")] == 80.0           # row coverage, metric null in Q2 is fine here
    assert ("H", "reports") not in out            # H1 only: dropped
    assert out[("M", "reports")] == 2.0 and out[("M", "pieces")] == 7.0


def test_annualize_with_redundant_double_counts(spark):
    out = _by(annualize(_obs(spark)))
    assert out[("Q", "reports")] == 109.0


def test_annualize_strict_per_metric(spark):
    out = _by(annualize_strict(drop_redundant(_obs(spark))))
    assert out[("Q", "reports")] == 10.0
    assert out[("Q", "pieces")] is None            # Q2 missing for this metric
    assert out[("H", "reports")] is None
    assert out[("M", "reports")] is None and out[("M", "pieces")] is None


def test_annualize_yearly_is_identity(spark):
    df = spark.createDataFrame([("A", "2020", 3.0), ("A", "2021", None)], "entity string, label string, v double")
    obs = observations(df.withColumn("p", parse_period("label")), "entity", "o", "p", ["v"])
    out = {r.period.year: r.value for r in annualize(obs).collect()}
    assert out == {2020: 3.0, 2021: None}


def test_rollup_variants(spark):
    obs = spark.createDataFrame(
        [("Meta", "r", "2020", "reports", 1.0), ("FB", "r", "2020", "reports", 2.0),
         ("IG", "r", "2020", "reports", None), ("MS", "r", "2020", "reports", 4.0),
         ("Skype", "r", "2020", "reports", 5.0), ("Solo", "r", "2020", "reports", None)],
        "entity string, observer string, period string, metric string, value double")
    own = spark.createDataFrame([("Meta", "FB"), ("Meta", "IG"), ("MS", "Skype")], "owner string, member string")
    drop = {r.entity: r.value for r in rollup(obs, own).collect()}
    assert drop == {"Meta": 3.0, "MS": 9.0, "Solo": None}
    keep = rollup(obs, own, keep_members=True)
    assert keep.count() == 6
    ex = {r.entity: r.value for r in rollup(obs, own, exclude_owners=["MS"]).collect()}
    assert ex["MS"] == 4.0 and ex["Skype"] == 5.0 and ex["Meta"] == 3.0


def test_add_fill_zero_and_row_sum(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None)], "k string, value double")
    b = spark.createDataFrame([("x", None), ("z", 2.0)], "k string, value double")
    out = {r.k: r.value for r in add_fill_zero(a, b, ["k"]).collect()}
    assert out == {"x": 1.0, "y": None, "z": 2.0}
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert [r.s for r in df.select(row_sum("a", "b").alias("s")).collect()] == [1.0, None]


def test_computed_columns(spark):
    obs = spark.createDataFrame(
        [("E", "o", "2020", "a", 2.0), ("E", "o", "2020", "b", 3.0), ("E", "o", "2020", "t", 1.0),
         ("E", "o", "2021", "a", None), ("E", "o", "2021", "b", None)],
        "entity string, observer string, period string, metric string, value double")
    rules = spark.createDataFrame(
        [("E", "sums", "t", "a"), ("E", "sums", "t", "b"), ("E", "products", "p", "a"), ("E", "products", "p", "b")],
        "entity string, kind string, target string, source string")
    out = {(r.period, r.metric): r.value for r in computed_columns(obs, rules).collect()}
    assert out[("2020", "t")] == 6.0          # published 1 + computed 5 (fill 0)
    assert out[("2020", "p")] == 6.0
    assert out[("2021", "t")] is None and out[("2021", "p")] is None


def _snaps(spark, rows):
    return spark.createDataFrame(rows, "k string, period int, snapshot int, value double")


def test_diff_identical_snapshots_is_empty(spark):
    s = _snaps(spark, [("a", 1, 1, 5.0), ("a", 1, 2, 5.0), ("b", 1, 1, 2.0), ("b", 1, 2, 2.0)])
    assert diff_snapshots(s, ["k", "period"]).count() == 0


def test_diff_nulls_and_missing_snapshot(spark):
    s = _snaps(spark, [
        ("a", 1, 1, 5.0), ("a", 1, 2, 6.0),        # changed
        ("b", 1, 1, None), ("b", 1, 2, 3.0),       # null on one side: ignored
        ("c", 1, 1, 1.0), ("c", 1, 3, 2.0),        # snapshot 2 missing: not adjacent
    ])
    d = diff_snapshots(s, ["k", "period"]).collect()
    assert [(r.k, r.snapshot, r.value_before, r.value_after) for r in d] == [("a", 1, 5.0, 6.0)]
    rate = {r.period: (r.changed, r.total) for r in divergence_rate(s, diff_snapshots(s, ["k", "period"])).collect()}
    assert rate == {2: (1, 3), 3: (0, 2)}  # every snapshot but the first gets a rate
    assert divergence_age(diff_snapshots(s, ["k", "period"]), "period").first().divergent == 1


def test_snapshots_from_increments(spark):
    inc = spark.createDataFrame([("a", 5, 4, 1.0), ("a", 5, 6, 2.0), ("b", 6, 6, 3.0)],
                                "k string, period int, known_at int, v double")
    s = {(r.k, r.snapshot): r.v for r in snapshots_from_increments(inc, ["k"], "period", "known_at", "v").collect()}
    assert s == {("a", 5): 1.0, ("a", 6): 3.0, ("b", 6): 3.0}


def test_dates_are_dates(spark):
    p = spark.range(1).select(parse_period(F.lit("2024 Q1")).alias("p")).first().p
    assert isinstance(p.end_date, dt.date) and p.end_date == dt.date(2024, 3, 31)


def test_conform_and_wide_keep_empty_columns(spark):
    from veracity.operators.observations import conform_columns, wide
    df = spark.createDataFrame([("a", 1.0)], "k string, pieces double")
    out = conform_columns(df, ["pieces", "reports"])
    assert out.columns == ["pieces", "reports"] and out.first().reports is None
    obs = spark.createDataFrame([("x", "2020", "reports", 2.0), ("x", "2020", "reports", 3.0)],
                                "entity string, period string, metric string, value double")
    w = wide(obs, ["entity", "period"], ["pieces", "reports"]).first()
    assert w.pieces is None and w.reports == 5.0
