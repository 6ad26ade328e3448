import pytest
from pyspark.sql import functions as F

from veracity.functions.stats import binomial_upper_tail, hypergeometric_upper_tail, log_factorial
from veracity.operators import audit as A


def test_sign_test_golden(spark):
    # 19 positive of 24 non-zero pairs: one-sided p = 0.003305
    p = spark.range(1).select(binomial_upper_tail(F.lit(19), F.lit(24), 0.5).alias("p")).first().p
    assert p == pytest.approx(0.0033054, abs=1e-7)
    edge = spark.range(1).select(binomial_upper_tail(F.lit(0), F.lit(5)).alias("a"),
                                 binomial_upper_tail(F.lit(6), F.lit(5)).alias("b")).first()
    assert edge.a == 1.0 and edge.b == 0.0


def test_fisher_golden(spark):
    # table [[3, 0], [2, 25]]: one-sided p = C(5,3) / C(30,3)
    p = spark.range(1).select(hypergeometric_upper_tail(F.lit(3), F.lit(0), F.lit(2), F.lit(25)).alias("p")).first().p
    assert p == pytest.approx(10 / 4060, rel=1e-9)


def test_log_factorial(spark):
    import math
    r = spark.range(1).select(log_factorial(F.lit(10)).alias("a"), log_factorial(F.lit(0)).alias("b")).first()
    assert r.a == pytest.approx(math.lgamma(11)) and r.b == 0.0


def test_compare_observers_nulls_and_zero(spark):
    df = spark.createDataFrame(
        [("A", 2020, 10.0, 5.0, 5.0, 100, 200),      # equal counts
         ("B", 2020, None, None, 4.0, 100, 200),     # sender missing -> pi falls back to receiver
         ("C", 2020, 3.0, 0.0, 0.0, 0, 0)],          # zero denominators
        "entity string, year int, pieces double, reports double, received double, esp long, total long")
    out = {r.entity: r for r in A.compare_observers(df).collect()}
    assert out["A"].delta_pct == 0.0 and out["A"].pi == 2.0 and out["A"].esp_pct == 5.0
    assert out["B"].delta_pct is None and out["B"].pi is None and out["B"].esp_pct == 4.0
    assert out["C"].delta_pct is None and out["C"].pi is None and out["C"].esp_pct is None


def test_pairs_and_sign(spark):
    audit = spark.createDataFrame(
        [("A", 2020, 10.0, 12.0), ("A", 2021, 10.0, 10.0), ("B", 2020, 8.0, 6.0), ("B", 2021, None, 3.0)],
        "entity string, year int, reports double, received double")
    pairs = A.comparable_pairs(audit)
    assert pairs.count() == 6
    d = A.pair_differences(pairs, "ServiceProvider", "Receiver")
    tally = {r.sign: r.n for r in A.sign_tally(d).collect()}
    assert tally == {1: 1, 0: 1, -1: 1}
    t = A.sign_test(d).first()
    assert (t.positive, t.n) == (1, 2) and t.p_value == pytest.approx(0.75)


def test_severity_bins(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (-20.0,), (100.0,), (150.0,), (None,)], "x double")
    got = [r.b for r in df.select(A.severity_bin("x").alias("b")).collect()]
    assert got == [0, 0, 1, 2, 3, None]
