"""CSV scans for untidy published tables (S-1 .. S-7, S-9).

Every scan declares its schema: columns are read as strings and then typed
with the lenient parsers of :mod:`veracity.functions.cells`, never with
``inferSchema`` (which costs an extra pass and guesses differently per file).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.functions.cells import parse_count, parse_number, round_significant


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",",
                     header: bool = True, null_value: str = "") -> DataFrame:
    """All-string scan with a declared header (S-6).

    The default ``nullValue`` of ``""`` keeps a literal ``NA`` (a country
    code) as a value, as required for S-5.
    """
    return (
        spark.read.schema(string_schema(columns))
        .option("header", header).option("sep", sep).option("nullValue", null_value)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_counts_csv(spark: SparkSession, path: str, columns: Sequence[str],
                    count_columns: Sequence[str], sep: str = ",") -> DataFrame:
    """CSV with thousands separators in the count columns (S-1)."""
    df = read_csv_strings(spark, path, columns, sep)
    return df.withColumns({c: parse_count(c) for c in count_columns})


def read_typed_subset(spark: SparkSession, path: str, columns: Sequence[str],
                      keep: dict[str, str], sep: str = ",") -> DataFrame:
    """Pruned, typed scan of a few columns of a wide file (S-2, S-4).

    ``keep`` maps column -> Spark type; the CSV reader only materialises the
    selected columns.
    """
    return type_subset(read_csv_strings(spark, path, columns, sep), keep)


def type_subset(df: DataFrame, keep: dict[str, str]) -> DataFrame:
    """Keep and type a subset of string columns; unparseable cells become null (S-4)."""
    return df.select(*[F.col(c).try_cast(t).alias(c) if t != "string" else F.col(c) for c, t in keep.items()])


def read_with_preamble(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "|",
                       preamble: str = "sep=") -> DataFrame:
    """Concatenated batches each starting with a ``sep=|`` line and a header (S-3).

    Lines are read as text, preamble and repeated header lines dropped, and
    the rest parsed with ``from_csv`` -- so batches can be any number of
    files, all read in parallel.
    """
    header_line = sep.join(columns)
    lines = spark.read.text(path)
    body = lines.where(~F.col("value").startswith(preamble) & (F.col("value") != header_line)
                       & (F.length("value") > 0))
    ddl = ", ".join(f"`{c}` STRING" for c in columns)
    parsed = body.select(F.from_csv("value", ddl, {"sep": sep}).alias("r"))
    return parsed.select("r.*")


def read_with_converters(spark: SparkSession, path: str, columns: Sequence[str],
                         casefold: Sequence[str] = (), significant: dict[str, int] | None = None) -> DataFrame:
    """Lower-cased headers, case-folded categories, numbers rounded to
    significant digits (S-9, F-11, F-18)."""
    df = read_csv_strings(spark, path, columns)
    df = df.toDF(*[c.lower() for c in df.columns])
    for c in casefold:
        df = df.withColumn(c.lower(), F.lower(F.col(c.lower())))
    for c, digits in (significant or {}).items():
        df = df.withColumn(c.lower(), round_significant(parse_number(c.lower()), digits))
    return df


def read_snapshots(spark: SparkSession, path_glob: str, columns: Sequence[str],
                   snapshot_pattern: str) -> DataFrame:
    """Many snapshot files, the snapshot id parsed from each file's path (S-7).

    ``snapshot_pattern`` has two groups, year and quarter, e.g.
    ``r"snap-(\\d{4})-q(\\d)"``; the result gets ``snapshot`` as a quarter
    index.  With Hive-style partition folders Spark prunes them when a
    query filters on the snapshot (S-8).
    """
    df = read_csv_strings(spark, path_glob, columns).withColumn("_path", F.col("_metadata.file_path"))
    year = F.regexp_extract("_path", snapshot_pattern, 1).cast("int")
    quarter = F.regexp_extract("_path", snapshot_pattern, 2).cast("int")
    return df.withColumn("snapshot", year * 4 + quarter - 1).drop("_path")
