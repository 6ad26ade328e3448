"""Exact tests against integer arithmetic, and with counts in the billions."""

from fractions import Fraction
from math import comb, erfc, sqrt

import pytest
from pyspark.sql import functions as F

from veracity.functions.stats import binomial_upper_tail, fisher_two_sided, hypergeometric_upper_tail

SIGNS = [(19, 24), (0, 5), (6, 5), (1, 1), (12, 24), (5, 24), (24, 24), (1, 24), (600, 1000), (480, 1000), (2600, 5000)]
TABLES = [(3, 0, 2, 25), (1, 9, 11, 3), (0, 5, 5, 0), (5, 0, 0, 5), (10, 10, 10, 10), (2, 3, 4, 0), (0, 0, 3, 4), (3, 4, 0, 0),
          (300, 200, 250, 260), (20, 480, 40, 460), (7, 93, 700, 9300), (1, 0, 0, 0), (0, 1, 1, 0), (2, 2, 2, 2), (0, 0, 0, 3)]


def hypergeometric(a, b, c, d):
    m, k, n = a + c, a + b, a + b + c + d
    ways = {x: comb(m, x) * comb(n - m, k - x) for x in range(max(0, k + m - n), min(m, k) + 1)}
    upper = sum(w for x, w in ways.items() if x >= a)
    both = sum(w for w in ways.values() if w * 10**7 <= ways[a] * (10**7 + 1))
    return float(Fraction(upper, comb(n, k))), float(Fraction(both, comb(n, k)))


def test_sign_test_to_twelve_digits(spark):
    rows = spark.createDataFrame(SIGNS, "k long, n long").select("k", "n", binomial_upper_tail("k", "n").alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(float(Fraction(sum(comb(r.n, i) for i in range(r.k, r.n + 1)), 2**r.n)), rel=1e-12)


def test_unequal_odds(spark):
    for p in (0.01, 0.3, 0.97):
        q = Fraction(p)
        want = float(sum(comb(200, i) * q**i * (1 - q) ** (200 - i) for i in range(20, 201)))
        got = spark.range(1).select(binomial_upper_tail(F.lit(20), F.lit(200), p).alias("p")).first().p
        assert got == pytest.approx(want, rel=1e-11)


def test_fisher_to_twelve_digits(spark):
    rows = spark.createDataFrame(TABLES, "a long, b long, c long, d long").select(
        "*", hypergeometric_upper_tail("a", "b", "c", "d").alias("p"), fisher_two_sided("a", "b", "c", "d").alias("p2")).collect()
    for r in rows:
        assert (r.p, r.p2) == pytest.approx(hypergeometric(r.a, r.b, r.c, r.d), rel=1e-11), r


def test_counts_in_the_billions(spark):
    n, k = 4_000_000_000, 2_000_100_000
    a, b, c, d = 1_000_050_000, 999_950_000, 1_000_000_000, 1_000_000_000
    r = spark.createDataFrame([(k, n, a, b, c, d)], "k long, n long, a long, b long, c long, d long").select(
        binomial_upper_tail("k", "n").alias("sign"), hypergeometric_upper_tail("a", "b", "c", "d").alias("one"),
        fisher_two_sided("a", "b", "c", "d").alias("two")).first()
    assert r.sign == pytest.approx(0.5 * erfc((k - 0.5 - n / 2) / sqrt(n / 4) / sqrt(2)), rel=1e-6)
    assert 0 < r.one < 0.5 and r.two == pytest.approx(2 * r.one, rel=1e-3)
