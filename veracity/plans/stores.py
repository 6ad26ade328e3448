"""Queries over stored snapshots and scanned statements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.plans import domain as D
from veracity.plans import oracle as O
from veracity.sources import snapshots as S
from veracity.sources.sinks import scratch_path, write_csv

# The snapshot read, the last quarter of 2000, and the buckets of the store.
SNAPSHOT = 2000 * 4 + 3
BUCKETS = 8


def _store(spark: SparkSession, sf_dir: str) -> str:
    table = f"revenue_{uuid.uuid4().hex[:12]}"
    S.write_store(D.revenue_snapshots(spark, sf_dir), table, scratch_path(spark, "store"), D.SNAPSHOT_KEYS, BUCKETS)
    return table


def snapshot_store_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-8: one snapshot out of the partitioned store."""
    return S.read_snapshot(spark, _store(spark, sf_dir), SNAPSHOT).select(*D.SNAPSHOT_KEYS, "snapshot", "cents")


def snapshot_store_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-8, J-4: two stored snapshots compared bucket by bucket."""
    return S.diff_pair(spark, _store(spark, sf_dir), D.SNAPSHOT_KEYS, "cents", SNAPSHOT - 1)


def repeated_key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-4 with keys that a snapshot repeats: orders counted per (status, year) and snapshot
    (ship quarter), one row per priority, so every key has several rows in a snapshot."""
    from veracity.operators.revisions import diff_snapshots
    from veracity.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem").groupBy(
        "l_linestatus", "l_returnflag", F.year("l_shipdate").alias("snapshot"), F.col("l_linenumber")).agg(
        F.count("*").alias("lines"))
    return diff_snapshots(li, ["l_linestatus", "l_returnflag"], "snapshot", "lines").groupBy(
        "snapshot", "l_linestatus", "l_returnflag", "value_before", "value_after").agg(F.count("*").alias("pairs"))


# A statement's other fields, as functions of the document's id (``i``): SQL that both engines read.
_FIELDS = {
    "content_type": "case when i % 23 = 0 then 'CONTENT_TYPE_OTHER' else content_type end",
    "content_type_other": "case when i % 46 = 0 then 'poem' end",
    "decision_visibility_other": "case when i % 29 = 0 then repeat('x', 501) end",
    "decision_monetary": "case when i % 31 = 0 then 'DECISION_MONETARY_OTHER' when i % 37 = 0 then 'DECISION_MONETARY_GIFT' end",
    "decision_monetary_other": "case when i % 62 = 0 then 'fee' end",
    "decision_provision": "case when i % 41 = 0 then 'DECISION_PROVISION_PARTIAL_SUSPENSION' when i % 43 = 0 then 'NONE' end",
    "source_identity": "case when i % 47 = 0 then repeat('s', 600) else 'someone, \"quoted\"' end",
    "account_type": "case when i % 3 = 0 then 'ACCOUNT_TYPE_BUSINESS' when i % 53 = 0 then 'ACCOUNT_TYPE_ROBOT' end",
    "illegal_content_explanation": "case when i % 59 = 0 then repeat('e', 2001) end",
    "incompatible_content_explanation": "case when i % 61 = 0 then repeat('e', 2001) else 'see, terms' end",
    "decision_ground_reference_url": "'https://example.org/terms'",
    "category_specification_other": "case when i % 67 = 0 then repeat('k', 501) end",
    "automated_decision": "case when i % 71 = 0 then 'AUTOMATED_DECISION_MAYBE' else automated_decision end",
}
_BAD_DATE = "i % 50 = 7"


def statement_scan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-11, A-33: statements written as CSV with sets as JSON arrays, some lines malformed,
    scanned by the declared schema and checked; a malformed line is one more violation."""
    from veracity.operators.quality import statement_violations
    from veracity.sources.statements import SET_ENUMS, STATEMENT_SCHEMA, read_statements
    names = [f.name for f in STATEMENT_SCHEMA.fields]
    st = D.statements(spark, sf_dir).withColumn("i", F.expr("cast(substr(uuid, 5) as bigint)"))
    st = st.withColumns({k: F.expr(v) for k, v in _FIELDS.items()} | {
        f"end_date_{k}_restriction": F.date_add("application_date", 30 + n)
        for n, k in enumerate(("visibility", "monetary", "service", "account"))}
        | {"incompatible_content_illegal": F.expr("i % 2 = 0")})
    flat = st.withColumns({n: F.to_json(n) for n in SET_ENUMS} | {"application_date": F.expr(
        f"case when {_BAD_DATE} then '2024-13-45' else cast(application_date as string) end")})
    path = scratch_path(spark, "statements")
    write_csv(flat, path, names)
    read = read_statements(spark, path, "csv", corrupt="malformed")
    broken = read.where("malformed is not null").select("uuid", F.lit("malformed").alias("field"), F.lit("scan").alias("rule"))
    return statement_violations(read).unionByName(broken)


QUERIES = {f.__name__: f for f in (snapshot_store_read, snapshot_store_diff, repeated_key_diff, statement_scan_violations)}

ORACLE = {
    "snapshot_store_read": O.SNAP + f"""
SELECT nation, priority, status, period, CAST(snapshot AS INTEGER) AS snapshot, cents FROM snaps WHERE snapshot = {SNAPSHOT}""",
    "snapshot_store_diff": O.SNAP + f"""
SELECT CAST({SNAPSHOT - 1} AS INTEGER) AS snapshot, nation, priority, status, period, a.cents AS value_before, b.cents AS value_after
FROM (SELECT * FROM snaps WHERE snapshot = {SNAPSHOT - 1}) a
JOIN (SELECT * FROM snaps WHERE snapshot = {SNAPSHOT}) b USING (nation, priority, status, period)
WHERE a.cents <> b.cents""",
    "repeated_key_diff": """
WITH s AS (SELECT l_linestatus, l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS snapshot, l_linenumber, count(*) AS lines
           FROM lineitem GROUP BY ALL)
SELECT a.snapshot, a.l_linestatus, a.l_returnflag, a.lines AS value_before, b.lines AS value_after, count(*) AS pairs
FROM s a JOIN s b ON a.l_linestatus = b.l_linestatus AND a.l_returnflag = b.l_returnflag AND b.snapshot = a.snapshot + 1
WHERE a.lines <> b.lines GROUP BY ALL""",
    "statement_scan_violations": O.with_(O.STATEMENTS.replace("st AS (", "st0 AS (", 1)) + """,
st1 AS (SELECT *, CAST(substr(uuid, 5) AS BIGINT) AS i FROM st0),
st AS (SELECT * REPLACE (""" + ", ".join(
        f"{v} AS {k}" for k, v in _FIELDS.items() if k != "decision_ground_reference_url") + f""",
         CASE WHEN {_BAD_DATE} THEN NULL ELSE application_date END AS application_date) FROM st1)
""" + O._violation_sql() + f"\nUNION ALL SELECT uuid, 'malformed', 'scan' FROM st WHERE {_BAD_DATE}",
}
