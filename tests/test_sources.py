import json
import os

from pyspark.sql import functions as F

from veracity.sources import csv as C
from veracity.sources.disclosures import cells_of, features_of, observations_of, ownership_of, read_collection
from veracity.sources.sinks import scratch_path


def _write(spark, name, text):
    path = scratch_path(spark, name).replace("file:", "")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.txt"), "w") as f:
        f.write(text)
    return path


def test_counts_csv_keeps_na(spark):
    p = _write(spark, "csv", 'country,iso2,2019\nNamibia,NA,"1,234"\nNowhere,,\n')
    df = C.read_counts_csv(spark, p, ["country", "iso2", "2019"], ["2019"]).collect()
    assert df[0].iso2 == "NA" and df[0]["2019"] == 1234
    assert df[1].iso2 is None and df[1]["2019"] is None


def test_preamble_batches(spark):
    p = _write(spark, "pipe", "sep=|\nIso3|Value\nAAA|1\nsep=|\nIso3|Value\nBBB|2\n")
    rows = C.read_with_preamble(spark, p, ["Iso3", "Value"]).orderBy("Iso3").collect()
    assert [(r.Iso3, r.Value) for r in rows] == [("AAA", "1"), ("BBB", "2")]


def test_converters(spark):
    p = _write(spark, "conv", "Metric,Result\nTotal REMOVED,123456\n")
    r = C.read_with_converters(spark, p, ["Metric", "Result"], casefold=["Metric"], significant={"Result": 3}).first()
    assert r.metric == "total removed" and r.result == 123000.0


def test_collection(spark):
    lines = [
        {"name": "@", "comments": ["metadata"]},
        {"name": "Firm", "brands": ["Brand"], "aka": ["OldFirm"], "columns": ["reports", "pieces", "note"],
         "schema": {"pieces": "float", "note": "string"},
         "features": {"data": "d", "history": "h", "terms": ["a", "b"], "quantities": "q",
                      "granularity": "g", "frequency": "f", "coverage": "c"},
         "rows": [{"2020 Q1": [1, "5.43 / 100 * 2,510,798", "x"]},
                  {"2020": [10, 20.5, None], "redundant": True}]},
        {"name": "Silent", "silent": True},
    ]
    p = _write(spark, "json", "\n".join(json.dumps(x) for x in lines) + "\n")
    coll = read_collection(spark, p)
    assert coll.count() == 2
    own = {(r.member, r.relation) for r in ownership_of(coll).collect()}
    assert own == {("Brand", "brand"), ("OldFirm", "aka")}
    feats = {r.entity: r for r in features_of(coll).collect()}
    assert feats["Firm"].terms == "a; b" and feats["Firm"].has_reports is True and feats["Silent"].has_reports is None
    cells = {(r.period.label, r.column): (r.value, r.redundant) for r in cells_of(coll).collect()}
    assert cells[("2020 Q1", "pieces")][0] == 5.43 / 100 * 2510798
    assert cells[("2020", "reports")] == (10.0, True)
    assert observations_of(coll).where(F.col("metric") == "note").count() == 0


def test_pipe_separated_typed_subset(spark):
    p = _write(spark, "pipe2", "Iso3|VariantId|TimeLabel|SexId|Value|Extra\nAAA|4|2020|3|1000|x\nBBB|2|2020|3|7|y\n")
    cols = ["Iso3", "VariantId", "TimeLabel", "SexId", "Value", "Extra"]
    df = C.read_typed_subset(spark, p, cols, {"Iso3": "string", "VariantId": "int", "SexId": "int", "Value": "bigint"},
                             sep="|")
    assert df.columns == ["Iso3", "VariantId", "SexId", "Value"]
    rows = df.where((F.col("VariantId") == 4) & (F.col("SexId") == 3)).collect()
    assert [(r.Iso3, r.Value) for r in rows] == [("AAA", 1000)]


def test_collection_export_roundtrip(spark):
    from veracity.functions.periods import parse_period
    from veracity.operators.observations import observations
    from veracity.sources.disclosures import to_collection_lines
    from veracity.sources.sinks import write_text_lines
    df = spark.createDataFrame([("E", "2020 Q1", 1.0, 2.5, False), ("E", "2020", 9.0, None, True)],
                               "e string, l string, reports double, pieces double, redundant boolean")
    obs = observations(df.withColumn("p", parse_period("l")), "e", "E", "p", ["reports", "pieces"], "redundant")
    path = scratch_path(spark, "export")
    write_text_lines(to_collection_lines(obs, ["reports", "pieces"]), path)
    back = {(r.period.label, r.metric): (r.value, r.redundant)
            for r in observations_of(read_collection(spark, path)).collect()}
    assert back == {("2020 Q1", "reports"): (1.0, False), ("2020 Q1", "pieces"): (2.5, False),
                    ("2020", "reports"): (9.0, True), ("2020", "pieces"): (None, True)}
