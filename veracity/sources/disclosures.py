"""Nested disclosure collections (S-10) and their export (K-2).

A collection maps a name to a record (or ``null``: surveyed but silent).
A record has optional ``aka``/``brands``/``sources``/``comments`` lists,
``features``, ``columns``, a ``schema`` of column types (default ``int``),
``sums``/``products`` rules and ``rows``: each row is one period label
mapped to an array of heterogeneous cells, plus an optional ``redundant``.

At scale a collection is stored as JSON Lines, one ``{"name": ..., record}``
per line, so every record parses in parallel.  The single-object form is
also accepted for small published files.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.functions.periods import parse_period
from veracity.sources.records import (FEATURE_FIELDS, computed_cells, observed, quarantine, raise_on, scan_cells,
                                      scan_records, scan_rules)

def read_collection(spark: SparkSession, path: str, single_object: bool = False) -> DataFrame:
    """``(entity, record)`` rows; silent entities have a null record.

    Row cells stay VARIANT until typed by the declared schema.
    """
    return scan_records(spark, path, single_object)


def ownership_of(collection: DataFrame) -> DataFrame:
    """``(owner, member, relation)`` from ``brands`` and former names ``aka`` (U-3)."""
    brands = collection.select(F.col("entity").alias("owner"), F.explode("record.brands").alias("member"),
                               F.lit("brand").alias("relation"))
    aka = collection.select(F.col("entity").alias("owner"), F.explode("record.aka").alias("member"),
                            F.lit("aka").alias("relation"))
    return brands.unionByName(aka).distinct()


def features_of(collection: DataFrame) -> DataFrame:
    """One feature row per entity, terms joined with '; ' and ``has_reports`` (R-5, F-14)."""
    r = F.col("record")
    has_reports = (
        F.coalesce(F.array_contains(r["columns"], "reports"), F.lit(False))
        | F.coalesce(F.array_contains(F.map_keys(r["sums"]), "reports"), F.lit(False))
        | F.coalesce(F.array_contains(F.map_keys(r["products"]), "reports"), F.lit(False))
    )
    def text(name):
        return F.expr(f"try_variant_get(record.features['{name}'], '$', 'string')").alias(name)

    return collection.select(
        "entity", text("data"), text("history"),
        F.concat_ws("; ", F.expr("try_cast(record.features['terms'] as array<string>)")).alias("terms"),
        *map(text, FEATURE_FIELDS[3:]),
        F.when(r["features"].isNotNull(), has_reports).alias("has_reports"),
    )


def cells_of(collection: DataFrame, strict: bool = False) -> DataFrame:
    """Long cells ``(entity, period, redundant, column, type, value, text, int_value)`` (S-10).

    A cell whose JSON type is not the declared one has a null value; rows
    with another number of cells or no valid period are left out (see
    ``records.quarantine`` for all of these).  A row with several periods
    raises: none of them may be lost.  With ``strict``, every broken rule
    raises.
    """
    rule = F.col("rule")
    told = (F.when(rule == "period_keys", F.concat(F.lit("several periods in a row of "), "entity"))
            .when(rule == "cell_count", F.concat(F.lit("cells and columns differ in number: "), "entity"))
            .otherwise(F.concat_ws(" ", rule, "entity", "label", "column", "found")))
    stops = rule.isNotNull() if strict else rule == "period_keys"
    checked = scan_cells(collection).where(F.when(stops, F.raise_error(told).cast("boolean")).otherwise(F.col("column").isNotNull()))
    return checked.select(
        "entity", parse_period("label", strict=strict).alias("period"), "redundant", "column", "type",
        F.coalesce(F.col("int_value").cast("double"), F.col("float_value")).alias("value"),
        F.coalesce("text", "json").alias("text"), "int_value")


def observations_of(collection: DataFrame, observer: str | None = None, strict: bool = False) -> DataFrame:
    """Numeric cells as canonical observations; the observer is the entity itself."""
    c = cells_of(collection, strict).where(F.col("type") != "string")
    return c.select(
        "entity", (F.lit(observer) if observer else F.col("entity")).alias("observer"),
        "period", F.col("column").alias("metric"), "value", "redundant")


def to_collection_lines(obs: DataFrame, metrics: list[str], features: DataFrame | None = None) -> DataFrame:
    """Rebuild one JSON record per entity from observations (K-2).

    Cells are ordered by ``metrics``; each record's rows are its periods,
    so a group holds one entity's history (bounded by the number of
    periods), never the whole table.  ``features(entity, features struct)``
    adds each entity's qualitative profile.  Rows of one period are one row
    unless ``obs`` tells them apart by a ``row`` column; a collection that was
    read goes back unchanged by ``records.export_records``.
    """
    row = ["row"] if "row" in obs.columns else []
    per_period = obs.groupBy("entity", F.col("period.label").alias("label"), "redundant", *row).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    cells = F.to_json(F.array(*[F.col(m) for m in metrics]))
    per_entity = per_period.groupBy("entity").agg(
        F.sort_array(F.collect_list(F.struct("label", "redundant", cells.alias("cells")))).alias("_rows"))

    def row_map(r):
        cells = F.parse_json(r["cells"])
        return F.when(r["redundant"], F.create_map(r["label"], cells, F.lit("redundant"), F.parse_json(F.lit("true")))) \
            .otherwise(F.create_map(r["label"], cells))

    if features is not None:
        per_entity = per_entity.join(features, "entity", "left")
    return per_entity.select(
        F.to_json(F.struct(
            F.col("entity").alias("name"),
            *([F.col("features")] if features is not None else []),
            F.array(*[F.lit(m) for m in metrics]).alias("columns"),
            F.create_map(*[x for m in metrics for x in (F.lit(m), F.lit("float"))]).alias("schema"),
            F.transform("_rows", row_map).alias("rows"),
        )).alias("value"))


def rules_of(collection: DataFrame) -> DataFrame:
    """Computed-column rules ``(entity, kind, target, source)`` from ``sums``
    and ``products`` (A-3)."""
    parts = []
    for kind in ("sums", "products"):
        parts.append(collection.select("entity", F.explode(f"record.{kind}").alias("target", "sources"))
                     .select("entity", F.lit(kind).alias("kind"), "target", F.explode("sources").alias("source")))
    return parts[0].unionByName(parts[1])


class Collection(NamedTuple):
    """Everything one collection holds, as lazy DataFrames."""

    observations: DataFrame
    ownership: DataFrame
    features: DataFrame
    quarantine: DataFrame


def ingest_collection(spark: SparkSession, path: str, include_redundant: bool = False,
                      single_object: bool = False, strict: bool = False) -> Collection:
    """Read a disclosure collection into observations (typed cells, redundant
    rows dropped unless asked for, computed columns applied), ownership,
    features and what broke a rule (S-10, P-12, A-3, A-31, U-3, R-5).  Whole
    numbers also come as ``int_value``; rows of one period stay apart.  With
    ``strict``, broken rules of cells and computed columns raise."""
    from veracity.operators.observations import drop_redundant

    coll = read_collection(spark, path, single_object)
    cells, rules = scan_cells(coll), scan_rules(coll)
    bad = quarantine(coll, cells)
    if strict:
        cells = raise_on(cells)
        rules = raise_on(rules.withColumns({"label": F.lit("rule"), "column": F.col("target")}))
    obs = drop_redundant(observed(computed_cells(cells, rules), strict), include_redundant)
    return Collection(obs, ownership_of(coll), features_of(coll), bad)
