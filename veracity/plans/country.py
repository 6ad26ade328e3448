"""Per-country enrichment as one lazy pipeline.

Inputs are already-scanned DataFrames (see :mod:`veracity.sources.csv` for
the untidy CSV forms):

* ``reports_wide(iso3, <year>...)`` - counts per country and year column;
* ``populations(iso3, year, population)`` - the denominator;
* ``online(iso3, year, online)`` - a second, optional denominator;
* ``countries(iso3, country, iso2, region)``;
* ``regions(superregion, region)`` - a two-level parent table;
* ``league(iso3)`` - members of a country group summarised as one row.

Result: one row per (iso3, year) with counts, shares, per-capita rate and
dimensions, plus one synthetic summary row per year for the league.
Dimension tables are small and fixed (a few hundred countries) and are
broadcast; facts are grouped with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.operators.enrich import member_flag, per_capita, resolve_parent, summary_rows
from veracity.operators.trends import share_of_group

# Reports without a country are added to this code's tally, and
# the synthetic league row uses this code and name.
UNASSIGNED_CODE = "USA"
LEAGUE_CODE, LEAGUE_NAME = "☪", "League"


def reports_long(reports_wide: DataFrame, years: Sequence[str]) -> DataFrame:
    """Wide year columns -> (iso3, year, reports): missing code -> the
    unassigned code, missing count -> 0, duplicate codes merged (R-1, P-15, A-1)."""
    filled = reports_wide.select(
        F.coalesce(F.col("iso3"), F.lit(UNASSIGNED_CODE)).alias("iso3"),
        *[F.coalesce(F.col(f"`{y}`").cast("bigint"), F.lit(0)).alias(y) for y in years])
    long = filled.unpivot(["iso3"], list(years), "year", "reports")
    return long.groupBy("iso3", "year").agg(F.sum("reports").alias("reports"))


def region_levels(regions: DataFrame) -> DataFrame:
    """(region, superregion, continent): a region's grandparent, or its parent
    when the parent has none (J-3)."""
    tree = resolve_parent(regions.select(F.col("region").alias("child"), F.col("superregion").alias("parent")))
    return tree.select(F.col("child").alias("region"), F.col("parent").alias("superregion"),
                       F.col("top").alias("continent"))


def reports_per_country(reports_wide: DataFrame, populations: DataFrame, online: DataFrame,
                        countries: DataFrame, regions: DataFrame, league: DataFrame,
                        years: Sequence[str]) -> DataFrame:
    """Join, share and summarise per-country counts (J-1, J-2, J-3, J-7, A-15, A-17, F-20)."""
    reports = reports_long(reports_wide, years)
    reports = reports.withColumn("reports_pct", share_of_group("reports", ["year"]))
    pops = populations.select("iso3", F.col("year").cast("string").alias("year"), "population") \
        .withColumn("population_pct", share_of_group("population", ["year"]))
    net = online.select("iso3", F.col("year").cast("string").alias("year"), "online") \
        .withColumn("online_pct", share_of_group("online", ["year"]))
    joined = per_capita(reports, pops, ["iso3", "year"])                      # inner: keys need a denominator
    joined = joined.join(net, ["iso3", "year"], "left")
    joined = joined.join(countries.select("iso3", "country", "iso2", "region"), "iso3", "left")
    joined = joined.join(region_levels(regions), "region", "left")
    flagged = member_flag(joined, league.select("iso3"), "iso3", "league")
    return summary_rows(
        flagged, F.col("league"), ["year"], ["reports", "reports_pct", "population", "population_pct"],
        {"iso3": LEAGUE_CODE, "iso2": LEAGUE_CODE, "country": LEAGUE_NAME, "league": False},
        ratios={"reports_per_capita": ("reports", "population")},
    )
