import json
import os

import pytest
from pyspark.sql import functions as F

from veracity.plans.country import LEAGUE_CODE, region_levels, reports_per_country
from veracity.sources.disclosures import ingest_collection
from veracity.sources.sinks import scratch_path


def test_reports_per_country(spark):
    wide = spark.createDataFrame(
        [("AAA", "1,000", "2,000"), (None, "5", None), ("USA", "10", "20"), ("BBB", None, "4"), ("BBB", "6", "6"),
         ("ZZZ", "1", "1")],
        "iso3 string, `2020` string, `2021` string")
    wide = wide.select("iso3", *[F.regexp_replace(F.col(f"`{y}`"), ",", "").alias(y) for y in ("2020", "2021")])
    pops = spark.createDataFrame([(c, y, p) for c, p in (("AAA", 100), ("USA", 300), ("BBB", 50)) for y in (2020, 2021)],
                                 "iso3 string, year int, population long")
    online = spark.createDataFrame([("AAA", 2020, 10)], "iso3 string, year int, online long")
    countries = spark.createDataFrame([("AAA", "Aland", "AA", "North"), ("USA", "States", "US", "West"),
                                       ("BBB", "Bland", "NA", "Europe")],
                                      "iso3 string, country string, iso2 string, region string")
    regions = spark.createDataFrame([("Americas", "North"), ("Americas", "West"), ("World", "Americas")],
                                    "superregion string, region string")
    league = spark.createDataFrame([("AAA",), ("BBB",)], "iso3 string")
    out = reports_per_country(wide, pops, online, countries, regions, league, ["2020", "2021"])
    rows = {(r.iso3, r.year): r for r in out.collect()}
    assert rows[("USA", "2020")].reports == 15          # unassigned reports go to USA
    assert rows[("BBB", "2021")].reports == 10          # duplicate codes merged
    assert ("ZZZ", "2020") not in rows                  # no denominator: dropped by the inner join
    assert rows[("AAA", "2020")].reports_per_capita == pytest.approx(10.0)
    assert rows[("AAA", "2020")].online == 10 and rows[("USA", "2020")].online is None
    assert rows[("BBB", "2020")].iso2 == "NA"
    assert (rows[("AAA", "2020")].superregion, rows[("AAA", "2020")].continent) == ("Americas", "World")
    league_row = rows[(LEAGUE_CODE, "2020")]
    assert league_row.reports == 1006 and league_row.reports_per_capita == pytest.approx(1006 / 150)
    shares = out.where(F.col("iso3") != LEAGUE_CODE).groupBy("year").agg(F.sum("reports_pct").alias("s")).collect()
    # Shares are taken over all reports, before the inner join drops ZZZ (1 of 1,022 in 2020).
    assert {r.year: r.s for r in shares}["2020"] == pytest.approx(100.0 * 1021 / 1022)
    assert {r.region: r.continent for r in region_levels(regions).collect()}["Americas"] == "World"


def test_ingest_collection_applies_rules(spark):
    path = scratch_path(spark, "ingest").replace("file:", "")
    os.makedirs(path, exist_ok=True)
    lines = [
        {"name": "Firm", "brands": ["Brand"], "columns": ["a", "b"], "sums": {"total": ["a", "b"]},
         "rows": [{"2020 Q1": [1, 2]}, {"2020": [5, 5], "redundant": True}]},
        {"name": "Brand", "columns": ["a"], "rows": [{"2020 Q1": [3]}]},
    ]
    with open(os.path.join(path, "part-0.json"), "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines) + "\n")
    c = ingest_collection(spark, path)
    got = {(r.entity, r.period.label, r.metric): r.value for r in c.observations.collect()}
    assert got == {("Firm", "2020 Q1", "a"): 1.0, ("Firm", "2020 Q1", "b"): 2.0, ("Firm", "2020 Q1", "total"): 3.0,
                   ("Brand", "2020 Q1", "a"): 3.0}
    assert [(r.owner, r.member) for r in c.ownership.collect()] == [("Firm", "Brand")]
    with_redundant = ingest_collection(spark, path, include_redundant=True).observations
    assert with_redundant.where(F.col("redundant")).count() == 3
