"""Snapshots with repeated keys and in a store, atomic replacement, statement scans, lookups, rounding."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veracity.functions.cells import round_significant
from veracity.operators.joins import unique_scalar
from veracity.operators.revisions import diff_snapshots, repeated_keys, snapshot_as_of, snapshots_from_increments
from veracity.operators.trends import percent_of_base
from veracity.sources import snapshots as S
from veracity.sources.sinks import scratch_path, write_csv, write_text_lines
from veracity.sources.statements import STATEMENT_SCHEMA, read_statements


def test_repeated_keys_are_compared_row_by_row(spark):
    rows = [("a", 1, 5), ("a", 1, 6), ("a", 2, 7), ("b", 1, 1), ("b", 1, 2), ("b", 2, 2), ("b", 2, 3), ("c", 1, 1), ("c", 3, 2),
            ("d", 1, None), ("d", 2, 4), ("e", 1, 4), ("e", 2, None)]
    df = spark.createDataFrame(rows, "k string, snapshot int, value int")
    got = sorted(tuple(r) for r in diff_snapshots(df, ["k"]).collect())
    want = sorted((s, k, v, w) for k, s, v in rows for k2, s2, w in rows
                  if k == k2 and s2 == s + 1 and None not in (v, w) and v != w)
    assert got == want and len([r for r in got if r[1] == "a"]) == 2
    assert sorted(tuple(r) for r in repeated_keys(df, ["k"]).collect()) == [(1, "a", 2), (1, "b", 2), (2, "b", 2)]


def test_one_snapshot_without_the_others(spark):
    inc = spark.createDataFrame([("a", 1, 1, 5), ("a", 1, 3, 2), ("a", 2, 1, 1), ("b", 4, 2, 9), ("b", 1, 4, 3)],
                                "k string, period int, known_at int, value long")
    full = snapshots_from_increments(inc, ["k"], "period", "known_at", "value")
    for k in range(6):
        one = snapshot_as_of(inc, ["k"], "period", "known_at", "value", F.lit(k))
        want = full.where(F.col("snapshot") == k) if k <= 4 else full.where("snapshot = 4")
        assert sorted((r.k, r.period, r.value) for r in one.collect()) == sorted((r.k, r.period, r.value) for r in want.collect())


def test_store_prunes_partitions_and_moves_no_row(spark):
    df = spark.range(400).selectExpr("id % 40 as k", "cast(id / 40 as int) as snapshot", "(id * 7) % 11 as v")
    table = "store_" + os.urandom(4).hex()
    S.write_store(df, table, scratch_path(spark, "store"), ["k"], 4)
    one = S.read_snapshot(spark, table, 3)
    assert sorted((r.k, r.v) for r in one.collect()) == sorted((r.k, r.v) for r in df.where("snapshot = 3").collect())
    assert len(one.inputFiles()) <= 4 and len(spark.table(table).inputFiles()) > 30
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pair = S.diff_pair(spark, table, ["k"], "v", 3)
        plan = pair._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "PartitionFilters" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = diff_snapshots(df, ["k"], value="v").where("snapshot = 3")
    assert sorted(map(tuple, pair.collect())) == sorted(map(tuple, want.collect()))


def test_a_failing_write_leaves_the_old_file(spark):
    path = scratch_path(spark, "replace")
    write_csv(spark.range(3), path, ["id"])
    write_csv(spark.range(5), path, ["id"])  # replaced as a whole
    bad = spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(PySparkException):
        write_csv(bad, path, ["id"])
    assert spark.read.option("header", True).csv(path).count() == 5
    write_text_lines(spark.createDataFrame([("x",)], "value string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["x"]
    local = path.replace("file:", "")
    assert [f for f in os.listdir(os.path.dirname(local)) if os.path.basename(local) in f] == [os.path.basename(local)]


def test_a_swap_cut_short_is_made_good(spark):
    path = scratch_path(spark, "replace")
    write_csv(spark.range(3), path, ["id"])
    local = path.replace("file:", "")
    folder, name = os.path.split(local)
    os.rename(local, os.path.join(folder, f".{name}.old"))  # the state between the two renames
    with pytest.raises(PySparkException):
        write_csv(spark.range(2).select(F.raise_error(F.lit("stop")).cast("long").alias("id")), path, ["id"])
    assert spark.read.option("header", True).csv(path).count() == 3


def test_statements_from_csv_and_parquet(spark):
    names = [f.name for f in STATEMENT_SCHEMA.fields]
    row = {n: None for n in names} | {"uuid": "u1", "content_type": "CONTENT_TYPE_TEXT", "content_date": "2024-01-02",
                                      "decision_visibility": '["A","B;C"]', "territorial_scope": "DE;FR", "category_addition": "[]",
                                      "decision_facts": 'first "quoted", line\nsecond', "automated_detection": "true"}
    bad = row | {"uuid": "u2", "application_date": "2024-13-45"}
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in (row, bad)], ", ".join(f"{n} string" for n in names))
    path = scratch_path(spark, "st")
    write_csv(df, path, names)
    got = {r.uuid: r for r in read_statements(spark, path, "csv", corrupt="malformed").collect()}
    u1, u2 = got["u1"], got["u2"]
    assert u1.decision_visibility == ["A", "B;C"] and u1.territorial_scope == ["DE", "FR"] and u1.category_addition == []
    assert u1.decision_facts == row["decision_facts"] and u1.automated_detection is True and u1.malformed is None
    assert u2.application_date is None and u2.malformed == '{"application_date":"2024-13-45"}'
    typed = scratch_path(spark, "st")
    read_statements(spark, path, "csv").write.parquet(typed)
    assert read_statements(spark, typed).where("uuid = 'u1'").first().decision_visibility == ["A", "B;C"]


def test_a_lookup_must_be_unique(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (2, 30)], "k int, v int")
    assert df.select(unique_scalar(df.where("k = 2"), "v").alias("x")).first().x == 30
    for which in ("k = 1", "k = 3"):
        with pytest.raises(Exception, match="expected one row"):
            df.select(unique_scalar(df.where(which), "v").alias("x")).collect()
    with pytest.raises(Exception, match="several rows"):
        df.select(percent_of_base("v", [], "k", 1).alias("x")).collect()


def test_rounding_is_that_of_the_exact_value(spark):
    xs = [1245.0, 12.45, 1235.0, 0.125, 2.675, 999.5, 9995.0, 99.95, -12.45, 1e-5, 4.777e21, 1.5e300, 0.0, 123456789012345680.0]
    xs += [float(f"{n}5e{e}") for n in range(100, 1000, 37) for e in range(-9, 12)]
    for digits in (2, 3, 6):
        for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_significant("x", digits).alias("y")).collect():
            assert r.y == float(f"{r.x:.{digits}g}")
