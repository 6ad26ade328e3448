"""Typed cells, checked rules, quarantine and lossless export of disclosure records."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veracity.sources import records as R
from veracity.sources.disclosures import ingest_collection
from veracity.sources.sinks import scratch_path

PROFILE = {"data": None, "history": "h", "terms": ["a", "b"], "quantities": "counts", "granularity": "g",
           "frequency": "f", "coverage": "c"}
GOOD = {"name": "A", "aka": ["X"], "brands": ["B1", "B2"], "sources": ["u"], "comments": ["c1", 'c"2'], "features": PROFILE,
        "columns": ["n", "f", "t"], "schema": {"f": "float", "t": "string"}, "sums": {"s": ["n"], "m": ["n", "f"], "n": ["n"]},
        "products": {"p": ["n", "n"]},
        "rows": [{"2021": [9007199254740993, "5.43 / 100 * 2,510,798", 'q"uote']}, {"2020": [3, 0.25, None], "redundant": True},
                 {"2020": [3, 0.25, None]}, {"2020": [3, 0.25, None]}, {"2019 H2": [None, 7, "ü"]}]}
BAD = {"name": "B", "columns": ["n", "f", "t"], "schema": {"f": "float", "t": "string"}, "sums": {"x": ["n", "y"], "e": [], "w": ["t"]},
       "products": {"n": ["f"], "x": ["n"]}, "features": {**{k: "v" for k in PROFILE if k != "terms"}, "more": 1},
       "rows": [{"2020": ["7", 1, "t"]}, {"2020": [7.0, "12 / 100", 5]}, {"2020 Q5": [1, 1, "t"]}, {"2020": [1, 1]},
                {"2020": [1, 1, "t", 2]}, {"2020": [1, 1, "t"], "2021": [1, 1, "t"]}, {"redundant": True}, {"2020": "x"},
                {"2020": [True, [1], "t"]}, {"2020": [123456789012345678901234567890, True, None]}]}
TYPES = {"name": "C", "columns": ["redundant", "z"], "schema": {"z": "decimal"}, "rows": [{"2020": [1, 2]}]}
HALF = {"name": "D", "columns": ["z"]}
SILENT = {"name": "S", "silent": True}


def scan(spark, *records):
    path = scratch_path(spark, "records").replace("file:", "")
    os.makedirs(path)
    with open(os.path.join(path, "a.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in (*records, {"name": "@", "title": "t"})))
    return R.scan_records(spark, path), path


def test_export_gives_back_what_was_read(spark):
    records, _ = scan(spark, GOOD, SILENT, HALF)
    out = {r.entity: json.loads(r.value) for r in R.export_records(records).collect()}
    assert out == {"A": GOOD, "S": SILENT, "D": HALF}


def test_whole_numbers_and_rules(spark):
    records, _ = scan(spark, GOOD)
    got = {(r.row, r.metric): (r.int_value, r.value) for r in R.computed_cells(R.scan_cells(records), R.scan_rules(records)).collect()}
    big = 9007199254740993
    assert got[0, "n"][0] == 2 * big and got[0, "s"][0] == big          # a sum onto a published column adds to it
    assert got[0, "f"] == (None, 5.43 / 100 * 2510798) and got[0, "m"] == (None, float(big) + 5.43 / 100 * 2510798)
    assert got[0, "p"] == (None, float(big) ** 2)                       # past 64 bits
    assert [got[r, "p"] for r in (1, 2, 3)] == [(9, 9.0)] * 3            # duplicate rows stay apart
    assert got[4, "n"] == (None, None) and got[4, "m"] == (None, 7.0) and got[4, "p"] == (None, None)


def test_every_broken_rule_is_quarantined(spark):
    records, path = scan(spark, GOOD, BAD, TYPES, HALF, SILENT)
    got = sorted(((r.entity, r.period, r.column, r.rule, r.found) for r in R.quarantine(records).collect()), key=str)
    assert got == sorted([
        ("B", "2020", "n", "not_int", '"7"'), ("B", "2020", "n", "not_int", "7"), ("B", "2020", "f", "bad_expression", '"12 / 100"'),
        ("B", "2020", "t", "not_string", "5"), ("B", "2020 Q5", None, "period_label", "2020 Q5"),
        ("B", "2020", None, "cell_count", "2"), ("B", "2020", None, "cell_count", "4"),
        ("B", None, None, "period_keys", "2020, 2021"), ("B", None, None, "period_keys", ""), ("B", "2020", None, "cells", "2020"),
        ("B", "2020", "n", "not_int", "true"), ("B", "2020", "f", "not_number", "[1]"),
        ("B", "2020", "n", "not_int", "123456789012345678901234567890"), ("B", "2020", "f", "not_number", "true"),
        ("B", None, "x", "unknown_source", "y"), ("B", None, "e", "empty_sources", "sums"), ("B", None, "w", "text_source", "t"),
        ("B", None, "n", "product_onto_column", "products"), ("B", None, "x", "product_onto_sum", "products"),
        ("B", None, None, "feature_fields", "terms"), ("B", None, None, "feature_fields", "more"),
        ("C", None, "redundant", "reserved_column", "redundant"), ("C", None, "z", "schema_type", "decimal"),
        ("D", None, None, "missing_field", "rows")], key=str)
    lenient = ingest_collection(spark, path)
    assert lenient.quarantine.count() == len(got)
    assert lenient.observations.where("entity = 'A' and metric = 'n'").count() == 4  # the redundant row left out
    with pytest.raises(PySparkException, match="not_int|period|cell|bad|not_"):
        ingest_collection(spark, path, strict=True).observations.collect()


def test_strict_passes_clean_records(spark):
    _, path = scan(spark, GOOD, SILENT)
    obs = ingest_collection(spark, path, include_redundant=True, strict=True).observations
    assert obs.count() == 5 * 5
    assert obs.where(F.col("redundant")).count() == 5


def test_broken_rules_raise_when_strict(spark):
    _, path = scan(spark, {**GOOD, "products": {"n": ["n"]}})
    with pytest.raises(PySparkException, match="product_onto_column"):
        ingest_collection(spark, path, strict=True).observations.collect()
