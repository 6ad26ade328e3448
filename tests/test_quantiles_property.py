import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veracity.operators.trends import describe, exact_quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)

values = st.lists(
    st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
    min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=st.lists(values, min_size=1, max_size=3), buckets=st.sampled_from([1, 2, 7, 1024]))
def test_exact_quantiles_match_numpy(spark, groups, buckets):
    rows = [(g, v) for g, vs in enumerate(groups) for v in vs]
    df = spark.createDataFrame(rows, "g int, x double")
    out = {r.g: r for r in exact_quantiles(df, ["g"], "x", PROBS, buckets=buckets).collect()}
    for g, vs in enumerate(groups):
        want = np.percentile(vs, [p * 100 for p in PROBS])
        got = [out[g][f"q{i}"] for i in range(len(PROBS))]
        assert got == pytest.approx(list(want), rel=1e-9, abs=1e-9)


def test_describe_matches_pandas(spark):
    import pandas as pd
    rng = np.random.default_rng(7)
    xs = np.round(rng.gamma(2.0, 1000.0, 500), 2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "x": xs})
    out = {r.g: r for r in describe(spark.createDataFrame(pdf), ["g"], "x").collect()}
    for g, part in pdf.groupby("g"):
        d = part["x"].describe()
        r = out[g]
        assert r["count"] == d["count"]
        assert [r.mean, r.std, r.min, r.p25, r.p50, r.p75, r.max] == pytest.approx(
            [d["mean"], d["std"], d["min"], d["25%"], d["50%"], d["75%"], d["max"]], rel=1e-9)


def test_ungrouped_quantiles_and_describe(spark):
    xs = [5.0, 1.0, 3.0, 3.0, 10.0, 7.5, 2.0, 2.0, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    q = exact_quantiles(df, [], "x", PROBS).first()
    assert [q[f"q{i}"] for i in range(len(PROBS))] == pytest.approx(list(np.percentile(xs, [p * 100 for p in PROBS])))
    d = describe(df, [], "x").first()
    assert (d["count"], d["min"], d["max"]) == (9, 1.0, 10.0)
    assert d.p50 == pytest.approx(np.median(xs)) and d.std == pytest.approx(np.std(xs, ddof=1))
