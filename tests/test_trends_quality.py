import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.operators import quality as Q
from veracity.operators import trends as T
from veracity.sources import statements as S


def test_shares_sum_to_100_and_running(spark):
    df = spark.createDataFrame([(2020, "a", 3), (2020, "b", 1), (2020, "c", 1), (2021, "a", 0)],
                               "year int, k string, v long")
    out = df.select("year", "k", T.share_of_group("v", ["year"]).alias("s"),
                    T.running_share("v", ["year"], [F.desc("v"), F.asc("k")]).alias("r")).collect()
    s2020 = [r.s for r in out if r.year == 2020]
    assert sum(s2020) == pytest.approx(100.0, abs=1e-9)
    assert [r.s for r in out if r.year == 2021] == [None]      # zero total: null, not an error
    assert max(r.r for r in out if r.year == 2020) == pytest.approx(100.0)


def test_top_shares_with_others(spark):
    df = spark.createDataFrame([(1, "a", 50), (1, "b", 30), (1, "c", 20)], "g int, k string, v long")
    out = {r.k: r.share for r in T.top_shares_with_others(df, "k", "v", ["g"], 25.0).collect()}
    assert out == {"a": 50.0, "b": 30.0, "Others": 20.0}


def test_rank_ties_break_on_key(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "y int, k string, v double")
    got = {r.k: r.rank for r in df.select("k", T.rank_within(["y"], [F.desc("v"), F.asc("k")]).alias("rank")).collect()}
    assert got == {"c": 1, "a": 2, "b": 3}


def test_exact_quantiles_match_numpy(spark):
    vals = [5.0, 1.0, 3.0, 3.0, 10.0, 7.5, 2.0]
    df = spark.createDataFrame([(1, v) for v in vals], "g int, x double")
    q = T.exact_quantiles(df, ["g"], "x", (0.0, 0.25, 0.5, 0.75, 1.0)).first()
    assert [q.q0, q.q1, q.q2, q.q3, q.q4] == pytest.approx(list(np.percentile(vals, [0, 25, 50, 75, 100])))


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (2.0,)], "x double")
    lo, hi = F.lit(0.0), F.lit(10.0)
    got = df.select(T.equal_width_bin("x", lo, hi, 5).alias("h"),
                    T.equal_width_bin("x", lo, hi, 5, right_closed=True).alias("c")).collect()
    assert [r.h for r in got] == [1, 3, 5, 2]      # maximum clamped into the last bin
    assert [r.c for r in got] == [1, 3, 5, 1]      # right-closed: 2.0 closes bin 1


def test_fits(spark):
    df = spark.createDataFrame([("a", x, 3.0 + 2.0 * x) for x in range(6)], "k string, x int, y double")
    f = T.linear_fit(df, ["k"], "x", "y").first()
    assert f.slope == pytest.approx(2.0) and f.intercept == pytest.approx(3.0)
    e = spark.createDataFrame([("a", x, float(np.exp(0.5 + 0.1 * x))) for x in range(6)], "k string, x int, y double")
    for weighted in (False, True):
        r = T.exp_fit(e, ["k"], "x", "y", weighted=weighted).first()
        assert r.rate == pytest.approx(0.1) and r.log_scale == pytest.approx(0.5)


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    out = {r.check: r for r in Q.run_checks(df, [
        Q.Check("rows", F.count("*"), 2), Q.Check("nulls", F.count_if(F.col("s").isNull()), 0)]).collect()}
    assert out["rows"].ok and not out["nulls"].ok and out["nulls"].actual == 1.0
    prof = {r.column: r.nulls for r in Q.schema_profile(df, "t").collect()}
    assert prof == {"id": 0, "s": 1}


def _statement(spark, **over):
    base = {f.name: None for f in S.STATEMENT_SCHEMA.fields}
    base.update(uuid="u1", content_type="CONTENT_TYPE_TEXT", decision_visibility=["DECISION_VISIBILITY_CONTENT_REMOVED"],
                territorial_scope=list(S.EU), decision_facts="facts", decision_ground="DECISION_GROUND_ILLEGAL_CONTENT",
                illegal_content_legal_ground="law", category="STATEMENT_CATEGORY_VIOLENCE")
    base.update(over)
    return spark.createDataFrame([tuple(base[f.name] for f in S.STATEMENT_SCHEMA.fields)], S.STATEMENT_SCHEMA)


def test_statement_rules(spark):
    import datetime as dt
    assert Q.statement_violations(_statement(spark)).count() == 0
    bad = _statement(spark, content_type="CONTENT_TYPE_HOLOGRAM", decision_facts="x" * 5001,
                     application_date=dt.date(2019, 12, 31), territorial_scope=["DE", "CH"],
                     illegal_content_legal_ground=None)
    got = {(r.field, r.rule) for r in Q.statement_violations(bad).collect()}
    assert got == {("content_type", "enum"), ("decision_facts", "max_length"), ("application_date", "min_date"),
                   ("territorial_scope", "enum"), ("illegal_content_legal_ground", "required")}
    cov = {r.territory: r.statements for r in Q.territory_coverage(_statement(spark)).collect()}
    assert cov["EU"] == 1 and cov["EEA"] == 0 and cov["DE"] == 1


def test_record_violations(spark):
    rec = spark.createDataFrame(
        [("X", ["reports", "pieces"], {"reports": "int", "pieces": "long"},
          [("2020 Q1", ["1", "2"]), ("2020 Q5", ["1"])], {"total": ["reports", "items"]})],
        "entity string, columns array<string>, schema map<string,string>, "
        "rows array<struct<period:string,cells:array<string>>>, sums map<string,array<string>>")
    got = {(r.rule, r.detail) for r in Q.record_violations(rec).collect()}
    assert got == {("cell_count", "2020 Q5 1"), ("period_label", "2020 Q5"), ("schema_type", "long"),
                   ("unknown_source", "items")}
