"""Disclosure records built from ``customer`` orders, scanned, checked and exported.

Every customer publishes one record, one row per order year; sixteen kinds of
customers (key modulo 16) break one rule each or none.  Records are written
as JSON Lines and read back, so the queries run the whole scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.plans import domain as D
from veracity.sources import records as R
from veracity.sources.sinks import scratch_path, write_text_lines

# SQL that both engines read: a customer's row of one year, and its record.
# ``k`` is the kind of customer, ``i`` the place of the row (0 is the first).
_ROW = """concat('{"', cast(year as string), case when k = 4 and i = 0 then ' Q5' else '' end, '":[',
    case when k = 0 and i = 0 then '"7"' when k = 1 and i = 0 then '3.5' when k = 14 and i = 0 then '9007199254740993'
         else cast(orders as string) end, ',', cast(cents as string), ',',
    case when k = 3 and i = 0 then '"12 / 100"' when year % 2 = 0 then concat('"12.50 / 100 * ', cast(orders as string), '"')
         else concat(cast(orders as string), '.5') end, ',',
    case when k = 2 and i = 0 then '12' else concat('"', note, '"') end,
    case when k = 5 and i = 0 then ',1' else '' end, ']',
    case when k = 6 and i = 0 then ',"2192":[1]' else '' end,
    case when k = 14 and i > 0 then ',"redundant":true' else '' end, '}')"""
_RECORD = """concat('{"name":"C', cast(custkey as string), '",', case when k = 15 then '"silent":true' else concat(
    '"sources":["orders"],"comments":["kind ', cast(k as string), '"],',
    case when k = 12 then '"features":{"data":"d","extra":"e"},' else '' end,
    '"columns":["orders","cents","share","', case when k = 8 then 'redundant' else 'note' end, '"],',
    '"schema":{"share":"', case when k = 7 then 'decimal' else 'float' end, '","',
    case when k = 8 then 'redundant' else 'note' end, '":"string"},',
    '"sums":{"both":[', case when k = 10 then '' when k = 9 then '"orders","nope"' else '"orders","cents"' end,
    '],"mixed":["orders","share"]},"products":{"', case when k = 11 then 'cents' else 'area' end, '":["orders","cents"]}',
    case when k = 13 then '' else concat(',"rows":[', published, ']') end) end, '}')"""


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``custkey, k, value``: one JSON line per customer with orders."""
    per_year = D.read_table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.max("o_orderpriority").alias("note"))
    # A record holds one customer's years.
    rows = per_year.groupBy("custkey").agg(F.array_sort(F.collect_list(F.struct("year", "orders", "cents", "note"))).alias("r"))
    each = rows.selectExpr("custkey", "custkey % 16 as k", "posexplode(r) as (i, x)").selectExpr("custkey", "k", "i", "x.*")
    lines = each.selectExpr("custkey", "k", "i", f"{_ROW} as line").groupBy("custkey", "k").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(i, line))), x -> x.line), ',')").alias("published"))
    return lines.selectExpr("custkey", "k", f"{_RECORD} as value")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    write_text_lines(record_lines(spark, sf_dir).select("value"), path)
    return R.scan_records(spark, path)


def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-10, A-31, A-3: every broken rule of cells, rows, computed columns and records."""
    return R.quarantine(_records(spark, sf_dir))


def ingest_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-10, A-3, A-4: typed and computed numbers, whole numbers kept whole."""
    records = _records(spark, sf_dir)
    return R.computed_cells(R.scan_cells(records), R.scan_rules(records))


def export_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-2: records read and exported again, line by line as they were."""
    return R.export_records(_records(spark, sf_dir))


QUERIES = {f.__name__: f for f in (ingest_quarantine, ingest_numbers, export_unchanged)}

_YEARS = """years as (
  select o_custkey as custkey, o_custkey % 16 as k, cast(extract(year from o_orderdate) as integer) as year,
         count(*) as orders, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents, max(o_orderpriority) as note
  from orders group by all
), each as (
  select *, row_number() over (partition by custkey order by year) - 1 as i, count(*) over (partition by custkey) as n_rows
  from years
)"""

ORACLE = {
    "ingest_quarantine": f"""with {_YEARS},
kinds as (select distinct custkey, k from each),
bad as (
  select custkey, cast(year as string) as period, 'orders' as "column", 'not_int' as rule, '"7"' as found from each where k = 0 and i = 0
  union all select custkey, cast(year as string), 'orders', 'not_int', '3.5' from each where k = 1 and i = 0
  union all select custkey, cast(year as string), 'note', 'not_string', '12' from each where k = 2 and i = 0
  union all select custkey, cast(year as string), 'share', 'bad_expression', '"12 / 100"' from each where k = 3 and i = 0
  union all select custkey, concat(year, ' Q5'), null, 'period_label', concat(year, ' Q5') from each where k = 4 and i = 0
  union all select custkey, cast(year as string), null, 'cell_count', '5' from each where k = 5 and i = 0
  union all select custkey, null, null, 'period_keys', concat(year, ', 2192') from each where k = 6 and i = 0
  union all select custkey, null, 'share', 'schema_type', 'decimal' from kinds where k = 7
  union all select custkey, null, 'redundant', 'reserved_column', 'redundant' from kinds where k = 8
  union all select custkey, null, 'both', 'unknown_source', 'nope' from kinds where k = 9
  union all select custkey, null, 'both', 'empty_sources', 'sums' from kinds where k = 10
  union all select custkey, null, 'cents', 'product_onto_column', 'products' from kinds where k = 11
  union all select custkey, null, null, 'feature_fields', f from kinds,
    (select unnest(['history', 'terms', 'quantities', 'granularity', 'frequency', 'coverage', 'extra']) as f) where k = 12
  union all select custkey, null, null, 'missing_field', 'rows' from kinds where k = 13
)
select concat('C', custkey) as entity, period, "column", rule, found from bad""",
    "ingest_numbers": f"""with {_YEARS},
good as (
  select *, case when k in (0, 1) and i = 0 then null when k = 14 and i = 0 then 9007199254740993 else orders end as n,
         case when k = 7 or (k = 3 and i = 0) then null when year % 2 = 0 then 12.5::double / 100::double * orders else orders + 0.5::double end as share
  from each where k not in (13, 15) and not (k in (4, 5, 6) and i = 0)
), long as (
  select *, 'orders' as metric, n as int_value, cast(n as double) as value from good where not (k in (0, 1) and i = 0)
  union all select *, 'cents', cents, cast(cents as double) from good
  union all select *, 'share', null, share from good where not (k = 7 or (k = 3 and i = 0))
  union all select *, 'both', case when n is null then cents else n + cents end,
            case when n is null then cast(cents as double) else cast(n + cents as double) end from good where k not in (9, 10)
  union all select *, 'mixed', null, case when n is null then share when share is null then cast(n as double)
            else cast(n as double) + share end from good where not (n is null and share is null)
  union all select *, 'area', try_cast(coalesce(n, 1)::hugeint * cents as bigint), coalesce(cast(n as double), 1) * cents from good where k <> 11
)
select concat('C', custkey) as entity, cast(i as integer) as row, cast(year as string) as label, k = 14 and i > 0 as redundant, metric,
       cast(int_value as bigint) as int_value, value
from long""",
    "export_unchanged": f"""with {_YEARS},
lines as (select custkey, k, string_agg({_ROW}, ',' order by i) as published
          from each where not (k in (4, 5, 6) and i = 0) group by custkey, k),
kinds as (select custkey, k, coalesce(published, '') as published from (select distinct custkey, k from each) left join lines using (custkey, k))
select concat('C', custkey) as entity, {_RECORD} as value from kinds""",
}
