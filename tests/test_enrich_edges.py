import pytest
from pyspark.sql import functions as F

from veracity.operators import quality as Q
from veracity.operators.enrich import (apply_overrides, member_flag, per_capita, repair_keys, resolve_parent,
                                       summary_rows, without_denominator)
from veracity.operators.rollup import rollup


def test_renamed_firm_duplicates_merge(spark):
    # Edge 5: the same period reported under the old and the new name.
    obs = spark.createDataFrame(
        [("NewCo", "r", "2021", "reports", 5.0), ("OldCo", "r", "2021", "reports", 2.0),
         ("NewCo", "r", "2021", "reports", None)],
        "entity string, observer string, period string, metric string, value double")
    own = spark.createDataFrame([("NewCo", "OldCo", "aka")], "owner string, member string, relation string")
    assert {r.entity: r.value for r in rollup(obs, own).collect()} == {"NewCo": 7.0}


def test_missing_denominator_and_codes(spark):
    # Edge 8: a key with facts but no denominator; a key missing its code; a literal NA code.
    facts = spark.createDataFrame([("AAA", 2020, 10), ("BBB", 2020, 4), ("NA", 2020, 1)],
                                  "key string, year int, reports long")
    pop = spark.createDataFrame([("AAA", 2020, 100), ("NA", 2020, 50)], "key string, year int, population long")
    pc = {r.key: r.reports_per_capita for r in per_capita(facts, pop, ["key", "year"]).collect()}
    assert pc == {"AAA": 0.1, "NA": 0.02}
    missing = without_denominator(facts, pop, "key", ["year"], "reports").first()
    assert (missing.reports, missing.keys_without) == (4, 1)
    codes = spark.createDataFrame([("France", "-99"), ("Kosovo", None), ("Chile", "CHL")], "name string, code string")
    fixes = spark.createDataFrame([("France", "FRA")], "name string, fixed string")
    fixed = {r.name: r.code for r in repair_keys(codes, fixes, "code", "name").collect()}
    assert fixed == {"France": "FRA", "Kosovo": None, "Chile": "CHL"}


def test_overrides_flags_hierarchy_and_summary(spark):
    df = spark.createDataFrame([("a", 2020, 1), ("a", 2021, 2), ("b", 2020, 3)], "k string, year int, v long")
    ov = spark.createDataFrame([("a", 2021, None)], "k string, year int, new_value long")
    out = {(r.k, r.year): r.v for r in apply_overrides(df, ov, ["k", "year"], "v").collect()}
    assert out == {("a", 2020): 1, ("a", 2021): None, ("b", 2020): 3}
    flagged = {r.k: r.member for r in member_flag(df, spark.createDataFrame([("b",)], "k string"), "k", "member")
               .select("k", "member").distinct().collect()}
    assert flagged == {"a": False, "b": True}
    tree = spark.createDataFrame([("x", "West"), ("West", "World"), ("y", "Alone")], "child string, parent string")
    tops = {r.child: r.top for r in resolve_parent(tree).collect()}
    assert tops == {"x": "World", "West": "World", "y": "Alone"}
    summ = summary_rows(df, F.col("k") == "a", ["year"], ["v"], {"k": "A*"}).where(F.col("k") == "A*")
    assert {r.year: r.v for r in summ.collect()} == {2020: 1, 2021: 2}


def test_require_checks(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    ok = Q.run_checks(df, [Q.Check("rows", F.count("*"), 2)])
    assert Q.require_checks(ok).count() == 1
    with pytest.raises(AssertionError, match="rows"):
        Q.require_checks(Q.run_checks(df, [Q.Check("rows", F.count("*"), 3)]))
