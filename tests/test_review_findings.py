"""Cases in which rows or digits used to be lost without a word."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veracity.functions.periods import parse_period
from veracity.operators.quality import period_gaps
from veracity.session import checkpoint_dir
from veracity.sources.csv import read_with_converters
from veracity.sources.disclosures import cells_of, read_collection


def _gaps(spark, *labels):
    obs = spark.createDataFrame([("e", x) for x in labels], "entity string, p string").select(
        "entity", parse_period("p").alias("period"))
    return sorted((r.label, r.next_label, r.gap_days) for r in period_gaps(obs).collect())


def test_a_hole_under_a_longer_period_is_none(spark):
    assert [(a, b) for a, b, days in _gaps(spark, "2020", "2020 Q2", "2021 Q1") if days > 0] == []
    assert _gaps(spark, "2020 Q1", "2020 Q2", "2020 Q4") == [("2020 Q2", "2020 Q4", 92)]


def test_converters_read_thousands_separators(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text('Kind,Total\nA,"12,345"\nB,678\n')
    rows = read_with_converters(spark, str(path), ["Kind", "Total"], ["Kind"], {"Total": 3}).collect()
    assert sorted((r.kind, r.total) for r in rows) == [("a", 12300.0), ("b", 678.0)]


def _collection(spark, tmp_path, rows):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"firm": {"columns": ["reports", "pieces"], "rows": rows}}))
    return read_collection(spark, str(path), single_object=True)


def test_a_row_with_several_periods_raises(spark, tmp_path):
    coll = _collection(spark, tmp_path, [{"2020": [1, 2], "2021": [3, 4]}])
    with pytest.raises(PySparkException, match="several periods"):
        cells_of(coll).select("period", F.col("text")).collect()


def test_strict_cells_count(spark, tmp_path):
    coll = _collection(spark, tmp_path, [{"2020": [1, 2, 3]}])
    with pytest.raises(PySparkException, match="differ in number"):
        cells_of(coll, strict=True).select("column", "text").collect()


def test_a_cluster_session_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802 - Spark's name
            return None

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815 - Spark's name

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
