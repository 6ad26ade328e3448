"""Operators against brute-force Python versions of the documented semantics."""

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veracity.functions.periods import parse_period
from veracity.operators.revisions import diff_snapshots
from veracity.operators.rollup import annualize, annualize_strict

LABELS = ["2020", "2020 H1", "2020 H2", "2020 Q1", "2020 Q2", "2020 Q3", "2020 Q4", "2021 Q1", "2021 H2"]
MONTHS = {"": (1, 12), "H1": (1, 6), "H2": (7, 12), "Q1": (1, 3), "Q2": (4, 6), "Q3": (7, 9), "Q4": (10, 12)}
QUARTERS = {"": {1, 2, 3, 4}, "H1": {1, 2}, "H2": {3, 4}, "Q1": {1}, "Q2": {2}, "Q3": {3}, "Q4": {4}}

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(LABELS), st.sampled_from(["m", "n"]),
              st.one_of(st.none(), st.integers(0, 50).map(float))),
    min_size=1, max_size=25)


def _parts(label):
    year, _, tag = label.partition(" ")
    return int(year), tag


def _expected_annualize(rows):
    # Per (entity, year): keep the year when the rows reach month 1 and month 12; sum per metric (null if all null).
    months = defaultdict(list)
    sums = defaultdict(list)
    for e, label, m, v in rows:
        y, tag = _parts(label)
        months[(e, y)].append(MONTHS[tag])
        sums[(e, y, m)].append(v)
    out = {}
    for (e, y, m), vs in sums.items():
        lo = min(a for a, _ in months[(e, y)])
        hi = max(b for _, b in months[(e, y)])
        if lo == 1 and hi == 12:
            nn = [v for v in vs if v is not None]
            out[(e, y, m)] = sum(nn) if nn else None
    return out


def _expected_strict(rows):
    cover = defaultdict(set)
    sums = defaultdict(list)
    for e, label, m, v in rows:
        y, tag = _parts(label)
        sums[(e, y, m)].append(v)
        if v is not None:
            cover[(e, y, m)] |= QUARTERS[tag]
    return {k: (sum(v for v in vs if v is not None) if cover[k] == {1, 2, 3, 4} else None) for k, vs in sums.items()}


def _obs(spark, rows):
    df = spark.createDataFrame(rows, "entity string, label string, metric string, value double")
    return df.select("entity", F.lit("o").alias("observer"), parse_period("label").alias("period"), "metric",
                     "value", F.lit(False).alias("redundant"))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy)
def test_annualize_matches_brute_force(spark, rows):
    obs = _obs(spark, rows)
    got = {(r.entity, r.period.year, r.metric): r.value for r in annualize(obs).collect()}
    assert got == pytest.approx(_expected_annualize(rows))
    strict = {(r.entity, r.period.year, r.metric): r.value for r in annualize_strict(obs).collect()}
    assert strict == pytest.approx(_expected_strict(rows))


snap_strategy = st.dictionaries(
    st.tuples(st.sampled_from(["k1", "k2", "k3"]), st.integers(0, 5)),     # (key, snapshot)
    st.one_of(st.none(), st.integers(0, 3).map(float)), max_size=18)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(snaps=snap_strategy)
def test_diff_matches_pairwise_join(spark, snaps):
    rows = [(k, s, v) for (k, s), v in snaps.items()]
    df = spark.createDataFrame(rows, "k string, snapshot int, value double")
    got = sorted((r.snapshot, r.k, r.value_before, r.value_after) for r in diff_snapshots(df, ["k"]).collect())
    # Brute force: inner join of snapshot s with s + 1 on the key, both sides non-null and different.
    want = sorted((s, k, v, snaps[(k, s + 1)]) for (k, s), v in snaps.items()
                  if (k, s + 1) in snaps and v is not None and snaps[(k, s + 1)] is not None
                  and v != snaps[(k, s + 1)])
    assert got == want
