"""The corpus pipeline: quality rules, line dedup, near-duplicate removal,
benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents`` (cleaned texts in ``text``, their
length in ``n_chars``) for the documents they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.decontamination import drop_leaks
from veracity.llm.jaccard_join import keep_one
from veracity.llm.line_dedup import dedup_lines
from veracity.llm.packing import pack_documents
from veracity.llm.quality_rules import assess
from veracity.session import cut_lineage
from veracity.sources.tables import read_table


def _free(columns: list[str], name: str) -> str:
    """``name``, or the first longer form of it that no column has."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that the rules reject go."""
    name = _free(docs.columns, "_quality")
    judged = assess(docs, name=name)
    return _with_text(judged.where(F.col(f"{name}.kept")), docs.columns, F.col(f"{name}.clean_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document of which no word is left goes too."""
    name = _free(docs.columns, "_lines")
    cleaned = dedup_lines(docs, name=name, min_tokens=1)
    gone = (F.col(f"{name}.n_dropped_lines") > 0) & ~F.col(f"{name}.clean_text").rlike(r"[^\x20\x09-\x0D]")
    return _with_text(cleaned.where(~gone), docs.columns, F.col(f"{name}.clean_text"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("decontamination", decontamination), ("packing", packing)]

# Hash-based fingerprints, components and bin choice have no SQL form; the
# tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
