import datetime as dt

import pytest
from pyspark.sql import functions as F

from veracity.functions import cells as C
from veracity.functions import periods as P


def test_parse_period_forms(spark):
    df = spark.createDataFrame([("2022",), ("2022 H1",), ("2022 H2",), ("2022 Q3",), ("22 Q1",), ("2022Q1",)], "s string")
    rows = df.select("s", P.parse_period("s").alias("p")).collect()
    got = {r.s: r.p for r in rows}
    assert got["2022"].freq == "Y" and got["2022"].start_date == dt.date(2022, 1, 1)
    assert got["2022"].end_date == dt.date(2022, 12, 31)
    assert got["2022 H2"].start_date == dt.date(2022, 7, 1) and got["2022 H2"].end_date == dt.date(2022, 12, 31)
    assert got["2022 Q3"].start_date == dt.date(2022, 7, 1) and got["2022 Q3"].end_date == dt.date(2022, 9, 30)
    assert got["2022 Q3"].label == "2022 Q3"
    assert got["22 Q1"] is None and got["2022Q1"] is None


def test_parse_period_strict_raises(spark):
    df = spark.createDataFrame([("2022 Q5",)], "s string")
    with pytest.raises(Exception):
        df.select(P.parse_period("s", strict=True)).collect()


def test_quarter_index_and_spellings(spark):
    df = spark.createDataFrame([("Jan-Mar 2023",), ("Oct-Dec 2022",), ("2023q4",), ("2023Q2",), ("Q1 2023",)], "s string")
    got = {r.s: r.q for r in df.select("s", P.parse_quarter("s").alias("q")).collect()}
    assert got["Oct-Dec 2022"] + 1 == got["Jan-Mar 2023"]  # consecutive across years
    assert got["2023q4"] == 2023 * 4 + 3 and got["2023Q2"] == 2023 * 4 + 1
    assert got["Q1 2023"] is None
    labels = spark.range(1).select(
        P.quarter_label(F.lit(2023 * 4 + 1), "dash").alias("d"),
        P.quarter_label(F.lit(2023 * 4 + 1), "suffix").alias("s"),
        P.quarter_label(F.lit(2023 * 4 + 1), "months").alias("m"),
    ).first()
    assert (labels.d, labels.s, labels.m) == ("Q2-2023", "_q2_2023", "Apr-Jun 2023")


def test_period_quarters(spark):
    df = spark.createDataFrame([("2021 H2",)], "s string")
    q = df.select(P.period_quarters(P.parse_period("s")).alias("q")).first().q
    assert q == [2021 * 4 + 2, 2021 * 4 + 3]


def test_cells(spark):
    df = spark.createDataFrame(
        [("1,234,567", "5.43 / 100 * 2,510,798", "0.05%", "4%-5%", "bad")],
        "c string, e string, p string, r string, b string")
    r = df.select(
        C.parse_count("c").alias("c"), C.percent_expression("e").alias("e"), C.parse_percent("p").alias("p"),
        C.range_midpoint("r").alias("r"), C.parse_count("b").alias("b"), C.parse_measure("e").alias("m"),
    ).first()
    assert r.c == 1234567
    assert r.e.percent == 5.43 and r.e.total == 2510798
    assert r.e.value == pytest.approx(5.43 / 100 * 2510798)
    assert r.m == pytest.approx(136336.3314)
    assert r.p == 0.05 and r.r == 4.5 and r.b is None


def test_typed_cells(spark):
    df = spark.createDataFrame([("12",), ("1.5",), ('"5.43 / 100 * 1,000"',), ("null",), ('"x"',)], "c string")
    rows = df.select(C.typed_cell("c", "int").alias("i"), C.typed_cell("c", "float").alias("f")).collect()
    assert [r.i for r in rows] == [12.0, None, None, None, None]
    assert [r.f for r in rows][:4] == [12.0, 1.5, pytest.approx(54.3), None]
    with pytest.raises(Exception):
        df.select(C.typed_cell("c", "int", strict=True)).collect()


def test_round_significant(spark):
    df = spark.createDataFrame([(123456.0,), (-98.76,), (0.0,), (None,), (0.012345,)], "x double")
    got = [r.y for r in df.select(C.round_significant("x", 3).alias("y")).collect()]
    assert got[0] == 123000.0
    assert got[1] == pytest.approx(-98.8)
    assert got[2] == 0.0 and got[3] is None
    assert got[4] == pytest.approx(0.0123)
