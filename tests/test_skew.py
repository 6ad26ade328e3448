"""A hot group holding a third of all rows must not change any result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veracity.operators.rollup import rollup
from veracity.operators.trends import exact_quantiles


def test_hot_group_quantiles_and_rollup(spark):
    rng = np.random.default_rng(11)
    n = 3000
    groups = np.where(np.arange(n) < n // 3, "hot", rng.choice(["a", "b", "c", "d"], n))
    # The hot group's values are clustered (many distinct values in a tiny range)
    # with two far outliers, the worst case for equal-width buckets.
    values = np.where(groups == "hot", 1000 + rng.random(n) / 1000, rng.gamma(2.0, 50.0, n))
    values[0], values[1] = -1e6, 1e6
    pdf = pd.DataFrame({"g": groups, "x": values})
    df = spark.createDataFrame(pdf)
    probs = (0.01, 0.25, 0.5, 0.75, 0.99)
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))] for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(list(np.percentile(part["x"], [p * 100 for p in probs])), rel=1e-12)

    obs = df.select(F.col("g").alias("entity"), F.lit("o").alias("observer"), F.lit("2020").alias("period"),
                    F.lit("m").alias("metric"), F.col("x").alias("value"))
    own = spark.createDataFrame([("owner", "hot"), ("owner", "a")], "owner string, member string")
    out = {r.entity: r.value for r in rollup(obs, own, keys=("observer", "period", "metric")).collect()}
    want = pdf.assign(e=pdf["g"].replace({"hot": "owner", "a": "owner"})).groupby("e")["x"].sum()
    assert out == pytest.approx(want.to_dict(), rel=1e-9)


def test_clustered_values_are_never_ranked_in_one_large_group(spark):
    """Clusters inside clusters, a null group: no interval keeps more values than allowed."""
    from veracity.operators import trends as T

    rng = np.random.default_rng(3)
    hot = np.concatenate([1000 + rng.random(4000) / 1e6, 1000.5 + rng.random(2000) / 1e9, [-1e300, 1e300, -1.7e308, 1.7e308]])
    rows = [("hot", float(x)) for x in hot] + [(None, float(x)) for x in rng.gamma(2.0, 50.0, 900)] + [("one", 5.0)] * 50
    df = spark.createDataFrame(rows, "g string, x double")
    probs = (0.1, 0.25, 0.5, 0.75, 0.999)
    ranked = 40
    out = {r.g: [r[f"q{i}"] for i in range(len(probs))]
           for r in exact_quantiles(df, ["g"], "x", probs, buckets=64, ranked=ranked).collect()}
    for g in ("hot", None, "one"):
        own = [x for k, x in rows if k == g]
        assert out[g] == pytest.approx(list(np.percentile(own, [p * 100 for p in probs])), rel=1e-12)
    counts = df.groupBy("g", "x").agg(F.count("*").alias("_c"))
    targets = T._targets(counts, ["g"], "x", probs)
    sizes = []
    for _ in range(8):
        targets = spark.createDataFrame(targets.collect(), targets.schema)
        sizes.append(targets.agg(F.max("_d")).first()[0])
        if sizes[-1] <= ranked:
            break
        targets = T._refine(counts, targets, ["g"], "x", 64)
    assert sizes[0] > 5000 and sizes[-1] <= ranked
    largest = (T._in_intervals(counts, targets, ["g"], "x").groupBy("g", "_start").count().agg(F.max("count")).first()[0])
    assert largest <= ranked


def test_describe_keeps_the_null_group(spark):
    from veracity.operators.trends import describe
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 4.0), ("a", 3.0)], "g string, x double")
    out = {r.g: r for r in describe(df, ["g"], "x").collect()}
    assert (out[None].p25, out[None].p50, out[None].p75) == (1.5, 2.0, 3.0) and out["a"].p50 == 3.0
