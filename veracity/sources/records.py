"""Typed cells of nested disclosure records, with a quarantine (S-10, A-3, A-31, K-2).

Cells are read as VARIANT, so the JSON type itself says whether a cell is an
integer, a fraction, a text or something else: ``"7"`` is no integer, and
9007199254740993 keeps all its digits.  Every row and cell carries its place
in the record, so duplicate rows, row order and the cell's own text survive
to the export.

A broken rule does not stop the scan: the row, cell or record goes to the
quarantine with the rule's name, and everything else is kept.  ``strict``
scans raise instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.functions.cells import PERCENT_EXPR_PATTERN, SCHEMA_TYPES
from veracity.functions.periods import PERIOD_PATTERN, parse_period

RECORD_DDL = (
    "aka array<string>, brands array<string>, sources array<string>, comments array<string>, "
    "features map<string,variant>, columns array<string>, schema map<string,string>, "
    "sums map<string,array<string>>, products map<string,array<string>>, rows array<map<string,variant>>")

# The metadata entry of a collection, and the fields of a qualitative profile.
METADATA_KEY = "@"
FEATURE_FIELDS = ("data", "history", "terms", "quantities", "granularity", "frequency", "coverage")

QUARANTINE = "entity string, period string, column string, rule string, found string"
_NONE = "cast(null as string)"


def scan_records(spark: SparkSession, path: str, single_object: bool = False) -> DataFrame:
    """``(entity, record)`` rows; silent entities have a null record.

    One JSON record per line (``{"name": ..., ...}`` or ``{"name": ...,
    "silent": true}``), or one object per file for small published files.
    """
    raw = spark.read.text(path, wholetext=single_object)
    if single_object:
        parsed = raw.select(F.explode(F.from_json("value", f"map<string, struct<{RECORD_DDL}>>")).alias("entity", "record"))
    else:
        both = F.from_json("value", f"struct<name string, silent boolean, {RECORD_DDL}>")
        names = [f.split(" ")[0] for f in RECORD_DDL.split(", ") if " " in f]
        parsed = raw.select(both.alias("r")).select(
            F.col("r.name").alias("entity"),
            F.when(~F.coalesce(F.col("r.silent"), F.lit(False)), F.struct(*[F.col(f"r.{n}").alias(n) for n in names])).alias("record"))
    return parsed.where(F.col("entity") != METADATA_KEY)


def _rules(*pairs: tuple[str | Column, str]) -> Column:
    """Name of the first rule that is broken, null if none."""
    out = F.lit(None).cast("string")
    for broken, name in reversed(pairs):
        broken = F.expr(broken) if isinstance(broken, str) else broken
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def scan_rows(records: DataFrame) -> DataFrame:
    """One row per published row: ``entity, row, label, redundant, columns, schema, cells, rule, found``."""
    rows = records.where("record.columns is not null and record.rows is not null").select(
        "entity", F.col("record.columns").alias("columns"), F.col("record.schema").alias("schema"),
        F.posexplode("record.rows").alias("row", "r"))
    keyed = rows.select(
        "entity", "row", "columns", "schema",
        F.expr("filter(map_keys(r), k -> k != 'redundant')").alias("labels"),
        F.expr("coalesce(schema_of_variant(r['redundant']) = 'BOOLEAN' and try_variant_get(r['redundant'], '$', 'boolean'), false)")
        .alias("redundant"), "r")
    opened = keyed.select("entity", "row", "columns", "schema", "labels", "redundant", F.expr("get(labels, 0)").alias("label"),
                          F.expr("try_cast(r[get(labels, 0)] as array<variant>)").alias("cells"),
                          F.expr("schema_of_variant(r[get(labels, 0)]) like 'ARRAY%'").alias("is_list"))
    return opened.select(
        "entity", "row", "label", "redundant", "columns", "schema", "cells",
        _rules(("size(labels) != 1", "period_keys"), ("not coalesce(is_list, false)", "cells"),
               ("size(cells) != size(columns)", "cell_count"),
               (~F.col("label").rlike(PERIOD_PATTERN), "period_label")).alias("rule"),
        F.expr("case when size(labels) != 1 then array_join(array_sort(labels), ', ') "
               "when size(cells) != size(columns) then cast(size(cells) as string) else label end").alias("found"))


def scan_cells(records: DataFrame) -> DataFrame:
    """Every cell and every quarantined row of the records.

    ``entity, row, label, redundant, pos, column, type, json, int_value,
    float_value, text, rule, found``.  Integers stay ``bigint``; fractions
    and percentage expressions give ``float_value``; ``text`` is a string
    cell as it stands, an expression included.  A row that breaks a rule is
    one row here, without cells.
    """
    rows = scan_rows(records)
    cells = rows.select(
        "entity", "row", "label", "redundant", "columns", "schema", F.col("rule").alias("row_rule"), "found",
        F.posexplode_outer(F.expr("case when rule is null then cells end")).alias("pos", "cell"))
    named = cells.select(
        "entity", "row", "label", "redundant", "pos", "row_rule", "found", "cell",
        F.expr("case when row_rule is null then columns[pos] end").alias("column"),
        F.expr("case when row_rule is null then coalesce(schema[columns[pos]], 'int') end").alias("type"),
        F.expr("schema_of_variant(cell)").alias("kind"), F.expr("to_json(cell)").alias("json"))
    text = F.expr("case when kind = 'STRING' then try_variant_get(cell, '$', 'string') end")
    valued = named.withColumn("text", text).withColumn(
        "is_number", F.expr("kind in ('BIGINT', 'DOUBLE', 'FLOAT') or kind like 'DECIMAL%'"))
    percent = F.regexp_extract("text", PERCENT_EXPR_PATTERN, 1).cast("double")
    total = F.regexp_replace(F.regexp_extract("text", PERCENT_EXPR_PATTERN, 2), ",", "").cast("double")
    is_null = "kind = 'VOID'"
    return valued.select(
        "entity", "row", "label", "redundant", "pos", "column", "type", "json",
        F.expr("case when type = 'int' and kind = 'BIGINT' then try_variant_get(cell, '$', 'bigint') end").alias("int_value"),
        F.when(F.expr("type = 'float' and is_number"), F.expr("try_variant_get(cell, '$', 'double')"))
        .when((F.col("type") == "float") & F.col("text").rlike(PERCENT_EXPR_PATTERN), percent / 100.0 * total).alias("float_value"),
        "text",
        F.coalesce("row_rule", _rules(
            (~F.col("type").isin(*SCHEMA_TYPES), "schema_type"),
            (f"not {is_null} and type = 'int' and kind != 'BIGINT'", "not_int"),
            (f"not {is_null} and type = 'string' and kind != 'STRING'", "not_string"),
            ((F.col("type") == "float") & (F.col("kind") == "STRING") & ~F.col("text").rlike(PERCENT_EXPR_PATTERN), "bad_expression"),
            (f"not {is_null} and type = 'float' and kind != 'STRING' and not is_number", "not_number"))).alias("rule"),
        F.when(F.col("row_rule").isNotNull(), F.col("found")).otherwise(F.col("json")).alias("found"))


def scan_rules(records: DataFrame) -> DataFrame:
    """Computed columns as a checked graph: ``entity, kind, target, sources, is_int, rule, found``.

    Sources must be published columns, so the graph has no paths longer than
    one and no cycles; a target keeps whole numbers if all its sources do.
    """
    per_kind = [records.where(f"record.{kind} is not null").select(
        "entity", F.lit(kind).alias("kind"), F.expr("coalesce(record.columns, array())").alias("columns"),
        F.col("record.schema").alias("schema"), F.expr("coalesce(map_keys(record.sums), array())").alias("summed"),
        F.explode(f"record.{kind}").alias("target", "sources")) for kind in ("sums", "products")]
    graph = per_kind[0].unionByName(per_kind[1]).withColumn("sources", F.expr("coalesce(sources, array())")).withColumns({
        "unknown": F.expr("array_sort(array_except(sources, columns))"),
        "texts": F.expr("array_sort(filter(sources, s -> coalesce(schema[s], 'int') = 'string'))")})
    return graph.select(
        "entity", "kind", "target", "sources",
        F.expr("forall(sources, s -> coalesce(schema[s], 'int') = 'int')").alias("is_int"),
        _rules(("size(sources) = 0", "empty_sources"), ("size(unknown) > 0", "unknown_source"),
               ("size(texts) > 0", "text_source"),
               ("kind = 'products' and array_contains(columns, target)", "product_onto_column"),
               ("kind = 'products' and array_contains(summed, target)", "product_onto_sum")).alias("rule"),
        F.expr("case when size(unknown) > 0 then array_join(unknown, ', ') when size(texts) > 0 then array_join(texts, ', ') "
               "else kind end").alias("found"))


def record_quarantine(records: DataFrame) -> DataFrame:
    """Records that break a rule as a whole (``QUARANTINE``): columns, types, fields and profile."""
    r = records.where("record is not null").select("entity", "record.*")
    fields = ", ".join(f"'{f}'" for f in FEATURE_FIELDS)
    checks = F.expr(f"""concat(
        transform(filter(coalesce(columns, array()), c -> c = 'redundant'),
                  c -> named_struct('column', c, 'rule', 'reserved_column', 'found', c)),
        transform(filter(coalesce(array_distinct(columns), array()),
                         c -> not array_contains(array({", ".join(f"'{t}'" for t in SCHEMA_TYPES)}), coalesce(schema[c], 'int'))),
                  c -> named_struct('column', c, 'rule', 'schema_type', 'found', schema[c])),
        case when (columns is null) != (rows is null) or (columns is null and schema is not null) then transform(
                  filter(array(if(columns is null, 'columns', null), if(rows is null, 'rows', null)), f -> f is not null),
                  f -> named_struct('column', {_NONE}, 'rule', 'missing_field', 'found', f)) else array() end,
        case when size(map_keys(features)) > 0 then transform(
                  array_sort(concat(array_except(array({fields}), map_keys(features)), array_except(map_keys(features), array({fields})))),
                  f -> named_struct('column', {_NONE}, 'rule', 'feature_fields', 'found', f)) else array() end)""")
    return r.select("entity", F.explode(checks).alias("c")).selectExpr(
        "entity", f"{_NONE} as period", "c.column as column", "c.rule as rule", "c.found as found")


def quarantine(records: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Everything that breaks a rule: ``entity, period, column, rule, found``.

    Pass the scan's own ``cells`` so that both come from one pass.  A column
    of an unknown type is named once, not for each of its cells.
    """
    cells = scan_cells(records) if cells is None else cells
    bad_cells = cells.where("rule is not null and rule != 'schema_type'").selectExpr(
        "entity", "case when rule = 'period_keys' then null else label end as period", "column", "rule", "found")
    bad_rules = scan_rules(records).where("rule is not null").selectExpr(
        "entity", f"{_NONE} as period", "target as column", "rule", "found")
    return bad_cells.unionByName(bad_rules).unionByName(record_quarantine(records))


def raise_on(cells: DataFrame) -> DataFrame:
    """``cells`` unchanged, but a broken rule fails the job and names itself."""
    told = F.concat_ws(" ", F.col("rule"), "entity", "label", "column", "found")
    return cells.withColumn("rule", F.when(F.col("rule").isNotNull(), F.raise_error(told).cast("string")))


def computed_cells(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Published and computed numbers per row: ``entity, row, label, redundant, metric, int_value, value`` (A-3, A-4).

    A sum or product skips nulls and is null if all its sources are; a sum
    onto a published column is added to it.  Whole numbers stay ``bigint``;
    past 64 bits only the ``double`` value is left.
    """
    keys = ("entity", "row", "label", "redundant")
    numbers = cells.where("rule is null and type != 'string'").select(
        *keys, F.col("column").alias("metric"), F.col("type"), "int_value", "float_value")
    asked = rules.where("rule is null").select(
        "entity", "kind", "target", "is_int", F.explode("sources").alias("metric"))
    terms = numbers.join(asked, ["entity", "metric"])
    number = F.coalesce(F.col("int_value").cast("double"), F.col("float_value"))
    made = terms.groupBy(*keys, "kind", "target").agg(
        F.first("is_int").alias("is_int"), F.try_sum("int_value").alias("int_sum"), F.sum(number).alias("sum"),
        # A rule's few sources: the list is as long as the rule.
        F.collect_list("int_value").alias("ints"), F.product(number).alias("product")).select(
        *keys, F.col("target").alias("metric"), "is_int",
        F.expr("case when is_int then case when kind = 'sums' then int_sum when size(ints) > 0 then "
               "aggregate(ints, 1L, (a, x) -> try_multiply(a, x)) end end").alias("int_value"),
        F.expr("case when kind = 'sums' then sum else product end").alias("float_value"))
    published = numbers.select(*keys, "metric", (F.col("type") == "int").alias("is_int"), "int_value", "float_value")
    total = published.unionByName(made).groupBy(*keys, "metric").agg(
        F.every("is_int").alias("is_int"), F.try_sum("int_value").alias("ints"),
        F.sum(F.coalesce(F.col("int_value").cast("double"), F.col("float_value"))).alias("value"))
    return total.select(*keys, "metric", F.expr("case when is_int then ints end").alias("int_value"), "value")


def observed(numbers: DataFrame, strict: bool = False) -> DataFrame:
    """Canonical observations of :func:`computed_cells`, one per published row."""
    return numbers.select("entity", F.col("entity").alias("observer"), parse_period("label", strict).alias("period"),
                          "metric", "value", "redundant", "int_value")


def _field(name: str, json: str) -> str:
    return f"case when {json} is not null then concat('\"{name}\":', {json}) end"


def export_records(records: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One JSON line per record, as it was read (K-2): ``entity, value``.

    Rows come back in their order, duplicates included, with every cell's
    own JSON; rules, sources, comments and the profile too; a silent entity
    stays silent.  With ``cells`` the rows are built from those (for example
    after a repair), else from the scan.  A record is one line, so its rows
    meet in one task.
    """
    cells = scan_cells(records) if cells is None else cells
    rows = cells.where("column is not null").groupBy("entity", "row", "label", "redundant").agg(
        F.sort_array(F.collect_list(F.struct("pos", "json"))).alias("c"))
    lines = rows.select("entity", "row", F.expr(
        "concat('{', regexp_replace(to_json(array(label)), '^.|.$', ''), ':[', array_join(transform(c, x -> x.json), ','), ']', "
        "if(redundant, ',\"redundant\":true', ''), '}')").alias("line"))
    held = lines.groupBy("entity").agg(F.expr(
        "array_join(transform(sort_array(collect_list(struct(row, line))), x -> x.line), ',')").alias("lines"))
    r = records.join(held, "entity", "left").selectExpr("entity", "record is null as silent", "record.*", "lines")
    parts = [_field(n, f"to_json({n})") for n in ("aka", "brands", "sources", "comments", "features", "columns", "schema",
                                                  "sums", "products")]
    parts.append("case when rows is not null then concat('\"rows\":[', coalesce(lines, ''), ']') end")
    name = "concat('\"name\":', regexp_replace(to_json(array(entity)), '^.|.$', ''))"
    return r.select("entity", F.expr(
        f"concat('{{', case when silent then concat({name}, ',\"silent\":true') else concat_ws(',', {name}, {', '.join(parts)}) end, "
        f"'}}')").alias("value"))
