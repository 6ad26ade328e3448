"""Data-quality checks as DataFrames (A-11, A-29 .. A-34, A-36).

Checks never raise mid-pipeline: each returns rows describing what was
expected and what was found, computed in one aggregate pass per table, so
a caller can assert on them, persist them or gate a job with them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions.periods import PERIOD_PATTERN
from veracity.sources import statements as S


@dataclass(frozen=True)
class Check:
    """One named aggregate with its expected value.

    ``actual`` is an aggregate expression; ``expected`` a number or another
    aggregate; ``tolerance`` allows for float sums such as shares.
    """

    name: str
    actual: Column
    expected: Column | float | int
    tolerance: float = 0.0


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks of ``df`` in one aggregate pass -> ``(check, expected, actual, ok)`` (A-29)."""
    aggs = []
    for i, c in enumerate(checks):
        exp = c.expected if isinstance(c.expected, Column) else F.lit(c.expected)
        aggs.append(c.actual.cast("double").alias(f"a{i}"))
        aggs.append(exp.cast("double").alias(f"e{i}"))
    one = df.agg(*aggs)
    rows = [
        F.struct(F.lit(c.name).alias("check"), F.col(f"e{i}").alias("expected"),
                 F.col(f"a{i}").alias("actual"),
                 (F.abs(F.col(f"a{i}") - F.col(f"e{i}")) <= F.lit(c.tolerance)).alias("ok"))
        for i, c in enumerate(checks)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def require_checks(checks: DataFrame) -> DataFrame:
    """Strict mode: raise if any check failed, else return the checks.

    Only the checks table (one row per check) reaches the driver.
    """
    failed = [r for r in checks.where(~F.coalesce(F.col("ok"), F.lit(False))).collect()]
    if failed:
        detail = "; ".join(f"{r['check']}: expected {r['expected']}, got {r['actual']}" for r in failed)
        raise AssertionError(f"data-quality checks failed: {detail}")
    return checks


def schema_profile(df: DataFrame, table: str) -> DataFrame:
    """Column name, type and null count for every column, in one pass (A-30)."""
    counts = df.agg(*[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}")
                      for i, f in enumerate(df.schema.fields)])
    rows = [
        F.struct(F.lit(table).alias("table"), F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("nulls"))
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def period_gaps(obs: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Periods of an entity that do not abut what is covered before them (A-32).

    A period, in the order of (start, end), is compared with the earlier period
    that ends last, so days that a longer period covers are no hole.
    ``gap_days > 0`` is a hole, ``< 0`` an overlap.  Rows are first reduced to
    distinct periods per key, so a window group is one row per period.
    """
    periods = obs.select(*keys, F.col("period.label").alias("label"),
                         F.col("period.start_date").alias("start"),
                         F.col("period.end_date").alias("end")).distinct()
    w = Window.partitionBy(*keys).orderBy("start", "end", "label").rowsBetween(Window.unboundedPreceding, -1)
    covered = periods.select(*keys, F.col("label").alias("next_label"), F.col("start").alias("next_start"),
                             F.max(F.struct("end", "label")).over(w).alias("before"))
    gap = F.datediff(F.col("next_start"), F.col("before.end")) - 1
    return covered.where(F.col("before").isNotNull() & (gap != 0)).select(
        *keys, F.col("before.label").alias("label"), "next_label", gap.alias("gap_days"))


def record_violations(records: DataFrame) -> DataFrame:
    """Well-formedness of disclosure records (A-31).

    ``records(entity, columns array<string>, schema map<string,string>,
    rows array<struct<period string, cells array<string>>>, sums map<string,
    array<string>>)``.  Returns ``(entity, rule, detail)`` per violation.
    """
    allowed_types = F.array(*[F.lit(t) for t in ("int", "float", "string")])
    row_rules = records.select("entity", "columns", F.explode("rows").alias("r")).select(
        "entity",
        F.array(
            F.struct(F.lit("cell_count").alias("rule"),
                     F.concat_ws(" ", F.col("r.period"), F.size("r.cells").cast("string")).alias("detail"),
                     (F.size("r.cells") != F.size("columns")).alias("bad")),
            F.struct(F.lit("period_label").alias("rule"), F.col("r.period").alias("detail"),
                     (~F.col("r.period").rlike(PERIOD_PATTERN)).alias("bad")),
        ).alias("checks"))
    rec_rules = records.select(
        "entity",
        F.array(
            F.struct(F.lit("reserved_column").alias("rule"), F.lit("redundant").alias("detail"),
                     F.array_contains("columns", "redundant").alias("bad")),
            F.struct(F.lit("schema_type").alias("rule"),
                     F.array_join(F.array_sort(F.array_except(F.map_values("schema"), allowed_types)), ",").alias("detail"),
                     (F.size(F.array_except(F.coalesce(F.map_values("schema"), F.array().cast("array<string>")),
                                            allowed_types)) > 0).alias("bad")),
            F.struct(F.lit("unknown_source").alias("rule"),
                     F.array_join(F.array_sort(F.array_except(
                         F.flatten(F.coalesce(F.map_values("sums"), F.array().cast("array<array<string>>"))),
                         F.col("columns"))), ",").alias("detail"),
                     (F.size(F.array_except(
                         F.flatten(F.coalesce(F.map_values("sums"), F.array().cast("array<array<string>>"))),
                         F.col("columns"))) > 0).alias("bad")),
        ).alias("checks"))
    both = row_rules.unionByName(rec_rules)
    return both.select("entity", F.explode(F.filter("checks", lambda c: c["bad"])).alias("c")) \
        .select("entity", F.col("c.rule").alias("rule"), F.col("c.detail").alias("detail"))


def _sql_list(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def lit_array(values: Sequence[str]) -> Column:
    """A literal ``array<string>`` as one SQL expression (one driver round trip)."""
    return F.expr(f"array({_sql_list(values)})") if values else F.array().cast("array<string>")


_lit_array = lit_array


def statement_rules_sql() -> str:
    """All statement rules as one SQL ``array<struct<field, rule, bad>>``.

    Built as text so the JVM parses it once (dozens of rules with long
    vocabularies would otherwise cost hundreds of driver round trips).
    """
    empty = "CAST(array() AS array<string>)"
    rules = []
    for name, allowed in S.ENUMS.items():
        rules.append((name, "enum", f"{name} IS NOT NULL AND NOT {name} IN ({_sql_list(allowed)})"))
    for name, allowed in S.SET_ENUMS.items():
        rules.append((name, "enum",
                      f"size(array_except(coalesce({name}, {empty}), array({_sql_list(allowed)}))) > 0"))
    for name, limit in S.MAX_LENGTH.items():
        rules.append((name, "max_length", f"length({name}) > {limit}"))
    for name, first in S.MIN_DATE.items():
        rules.append((name, "min_date", f"{name} < DATE'{first}'"))
    rules += [
        ("decision_facts", "required", "decision_facts IS NULL OR length(decision_facts) = 0"),
        ("decision_visibility", "at_least_one_restriction",
         "coalesce(size(decision_visibility), 0) <= 0 AND decision_monetary IS NULL "
         "AND decision_provision IS NULL AND decision_account IS NULL"),
        ("content_type_other", "required", "content_type = 'CONTENT_TYPE_OTHER' AND content_type_other IS NULL"),
        ("decision_visibility_other", "required",
         f"array_contains(coalesce(decision_visibility, {empty}), 'DECISION_VISIBILITY_OTHER') "
         "AND decision_visibility_other IS NULL"),
        ("decision_monetary_other", "required",
         "decision_monetary = 'DECISION_MONETARY_OTHER' AND decision_monetary_other IS NULL"),
        ("illegal_content_legal_ground", "required",
         "decision_ground = 'DECISION_GROUND_ILLEGAL_CONTENT' AND illegal_content_legal_ground IS NULL"),
        ("incompatible_content_ground", "required",
         "decision_ground = 'DECISION_GROUND_INCOMPATIBLE_CONTENT' AND incompatible_content_ground IS NULL"),
    ]
    structs = ", ".join(
        f"named_struct('field', '{f}', 'rule', '{r}', 'bad', coalesce({cond}, false))" for f, r, cond in rules)
    return f"array({structs})"


def statement_violations(st: DataFrame) -> DataFrame:
    """Enum membership, length limits, earliest dates and required companion
    text of statements (A-33) -> ``(uuid, field, rule)``.

    One pass: each statement is exploded into only the rules it breaks.
    """
    checks = F.expr(statement_rules_sql())
    return st.select("uuid", F.explode(F.filter(checks, lambda c: c["bad"])).alias("c")) \
        .select("uuid", F.col("c.field").alias("field"), F.col("c.rule").alias("rule"))


def territory_coverage(st: DataFrame) -> DataFrame:
    """Statements per territory plus statements covering all of EU / EEA (A-34)."""
    scope = F.coalesce(F.col("territorial_scope"), F.array().cast("array<string>"))
    per = st.select(F.explode(F.array_distinct(scope)).alias("territory")).groupBy("territory") \
        .agg(F.count("*").alias("statements"))
    whole = st.agg(
        F.count_if(F.size(F.array_except(_lit_array(S.EU), scope)) == 0).alias("EU"),
        F.count_if(F.size(F.array_except(_lit_array(S.EEA), scope)) == 0).alias("EEA"),
    ).unpivot([], ["EU", "EEA"], "territory", "statements")
    return per.unionByName(whole)


def survey_counts(surveyed: DataFrame, firms: DataFrame, disclosing: DataFrame, key: str) -> DataFrame:
    """How many keys were surveyed, are firms, disclose, and are silent (A-36)."""
    silent = surveyed.select(key).distinct().join(disclosing.select(key).distinct(), key, "left_anti")
    parts = [
        surveyed.agg(F.count_distinct(key).alias("n")).withColumn("measure", F.lit("surveyed")),
        firms.agg(F.count_distinct(key).alias("n")).withColumn("measure", F.lit("firms")),
        disclosing.agg(F.count_distinct(key).alias("n")).withColumn("measure", F.lit("disclosing")),
        silent.agg(F.count("*").alias("n")).withColumn("measure", F.lit("silent")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("measure", "n")

