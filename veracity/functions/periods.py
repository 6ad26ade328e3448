"""Reporting periods as plain Spark expressions (F-1 .. F-6).

A period is a struct ``<label, freq, year, start_date, end_date>`` with
``freq`` one of ``Y`` (calendar year), ``H`` (half year) and ``Q``
(quarter).  Quarters are also addressed by a dense integer index
``year * 4 + quarter - 1`` so that "next quarter" is ``+ 1`` and a year is
``index div 4``.  No UDF or UDT: every helper returns a ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted period labels and quarter spellings.
PERIOD_PATTERN = r"^(\d{4})(?: (H[12]|Q[1-4]))?$"
QUARTER_MONTH_LABELS = ["Jan-Mar", "Apr-Jun", "Jul-Sep", "Oct-Dec"]
ALT_QUARTER_PATTERN = r"^(\d{4})[qQ]([1-4])$"

PERIOD_TYPE = (
    "struct<label:string,freq:string,year:int,start_date:date,end_date:date>"
)

def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


FREQUENCIES = ("Y", "H", "Q")


def _sql_operand(x) -> str | None:
    """SQL text for a column name or an int literal; None for a Column."""
    if isinstance(x, str):
        return "`" + x.replace("`", "``") + "`"
    if isinstance(x, int) and not isinstance(x, bool):
        return str(x)
    return None


_PERIOD_SQL = (
    "named_struct("
    "'label', CASE WHEN {f} = 'Q' THEN format_string('%04d Q%d', {y}, {p}) "
    "WHEN {f} = 'H' THEN format_string('%04d H%d', {y}, {p}) ELSE format_string('%04d', {y}) END, "
    "'freq', {f}, 'year', CAST({y} AS INT), "
    "'start_date', make_date({y}, {m}, 1), "
    "'end_date', last_day(add_months(make_date({y}, {m}, 1), "
    "CASE WHEN {f} = 'Q' THEN 2 WHEN {f} = 'H' THEN 5 ELSE 11 END)))"
)


def _period_sql(y: str, f: str, p: str) -> Column:
    m = f"CASE WHEN {f} = 'Q' THEN ({p} - 1) * 3 + 1 WHEN {f} = 'H' THEN ({p} - 1) * 6 + 1 ELSE 1 END"
    return F.expr(_PERIOD_SQL.format(f=f, y=y, p=p, m=m))


def make_period(year: str | Column, freq: str | Column, part: str | int | Column) -> Column:
    """Build the period struct from ``year``, ``freq`` and ``part``.

    ``freq`` is ``'Y'``, ``'H'`` or ``'Q'`` (a literal) or a column holding
    one of them; ``part`` is the half (1-2) or quarter (1-4), ignored for
    years.  Column names and literals compile to a single SQL expression
    (one call into the JVM instead of dozens); Columns use the builder.
    """
    f = f"'{freq}'" if isinstance(freq, str) and freq in FREQUENCIES else _sql_operand(freq)
    y, p = _sql_operand(year), _sql_operand(part)
    if y is not None and p is not None and f is not None:
        return _period_sql(y, f, p)
    year = F.col(year) if isinstance(year, str) else year
    part = F.col(part) if isinstance(part, str) else (F.lit(part) if isinstance(part, int) else part)
    freq = F.lit(freq) if isinstance(freq, str) and freq in FREQUENCIES else \
        (F.col(freq) if isinstance(freq, str) else freq)
    start_month = (
        F.when(freq == "Q", (part - 1) * 3 + 1)
        .when(freq == "H", (part - 1) * 6 + 1)
        .otherwise(F.lit(1))
    )
    n_months = F.when(freq == "Q", 3).when(freq == "H", 6).otherwise(12)
    start = F.make_date(year, start_month, F.lit(1))
    label = (
        F.when(freq == "Q", F.format_string("%04d Q%d", year, part))
        .when(freq == "H", F.format_string("%04d H%d", year, part))
        .otherwise(F.format_string("%04d", year))
    )
    return F.struct(
        label.alias("label"),
        freq.alias("freq"),
        year.cast("int").alias("year"),
        start.alias("start_date"),
        F.last_day(F.add_months(start, n_months - 1)).alias("end_date"),
    )


def parse_period(label: str | Column, strict: bool = False) -> Column:
    """Parse ``2022``, ``2022 H1`` or ``2022 Q3`` into a period struct (F-1).

    Lenient mode yields null for anything else; strict mode raises.
    """
    text = F.trim(_col(label))
    ok = text.rlike(PERIOD_PATTERN)
    year = F.regexp_extract(text, PERIOD_PATTERN, 1).cast("int")
    tag = F.regexp_extract(text, PERIOD_PATTERN, 2)
    freq = F.when(tag == "", F.lit("Y")).otherwise(F.substring(tag, 1, 1))
    part = F.when(tag == "", F.lit(1)).otherwise(F.substring(tag, 2, 1).cast("int"))
    parsed = make_period(year, freq, part)
    if strict:
        return F.when(ok, parsed).otherwise(
            F.raise_error(F.concat(F.lit('invalid period "'), text, F.lit('"')))
        )
    return F.when(ok, parsed)


def period_of_date(date: str | Column, freq: str | Column) -> Column:
    """The period of frequency ``freq`` that contains ``date``."""
    if isinstance(date, str) and isinstance(freq, str) and freq in FREQUENCIES:
        d = f"to_date({_sql_operand(date)})"
        part = {"Q": f"quarter({d})", "H": f"CAST(floor((month({d}) - 1) / 6) + 1 AS INT)", "Y": "1"}[freq]
        return _period_sql(f"year({d})", f"'{freq}'", part)
    d = F.to_date(_col(date))
    fq = F.lit(freq) if isinstance(freq, str) else freq
    part = F.when(fq == "Q", F.quarter(d)).when(fq == "H", F.floor((F.month(d) - 1) / 6) + 1)
    return make_period(F.year(d), fq, F.coalesce(part, F.lit(1)))


def quarter_index(year: str | Column, quarter: str | Column) -> Column:
    """Dense quarter number: consecutive quarters differ by exactly one (F-3)."""
    return _col(year) * 4 + _col(quarter) - 1


def quarter_index_of_date(date: str | Column) -> Column:
    d = _col(date)
    return quarter_index(F.year(d), F.quarter(d))


def index_year(qidx: str | Column) -> Column:
    """Year of a quarter index (F-4)."""
    return F.floor(_col(qidx) / 4).cast("int")


def index_quarter(qidx: str | Column) -> Column:
    """Quarter (1-4) of a quarter index (F-4)."""
    return (F.pmod(_col(qidx), F.lit(4)) + 1).cast("int")


def parse_quarter(text: str | Column) -> Column:
    """Quarter index from ``Jan-Mar 2023`` or ``2023q4`` spellings (F-2); else null."""
    t = F.trim(_col(text))
    labels = F.array(*[F.lit(s) for s in QUARTER_MONTH_LABELS])
    month_label = F.regexp_extract(t, r"^([A-Za-z]{3}-[A-Za-z]{3}) (\d{4})$", 1)
    pos = F.array_position(labels, month_label)
    long_year = F.regexp_extract(t, r"^([A-Za-z]{3}-[A-Za-z]{3}) (\d{4})$", 2)
    alt_year = F.regexp_extract(t, ALT_QUARTER_PATTERN, 1)
    alt_q = F.regexp_extract(t, ALT_QUARTER_PATTERN, 2)
    return (
        F.when(pos > 0, quarter_index(long_year.cast("int"), pos.cast("int")))
        .when(t.rlike(ALT_QUARTER_PATTERN), quarter_index(alt_year.cast("int"), alt_q.cast("int")))
    )


def quarter_label(qidx: str | Column, style: str = "space") -> Column:
    """Format a quarter index (F-5): ``space`` -> ``2023 Q2``, ``dash`` -> ``Q2-2023``,
    ``suffix`` -> ``_q2_2023``, ``compact`` -> ``2023q2``, ``months`` -> ``Apr-Jun 2023``."""
    y, q = index_year(qidx), index_quarter(qidx)
    if style == "space":
        return F.format_string("%04d Q%d", y, q)
    if style == "dash":
        return F.format_string("Q%d-%04d", q, y)
    if style == "suffix":
        return F.format_string("_q%d_%04d", q, y)
    if style == "compact":
        return F.format_string("%04dq%d", y, q)
    if style == "months":
        labels = F.array(*[F.lit(s) for s in QUARTER_MONTH_LABELS])
        return F.concat(F.element_at(labels, q), F.lit(" "), F.format_string("%04d", y))
    raise ValueError(f"unknown quarter label style {style!r}")


def start_month(period: str | Column) -> Column:
    """First month of a period (F-4)."""
    return F.month(_col(period).getField("start_date"))


def end_month(period: str | Column) -> Column:
    """Last month of a period (F-4)."""
    return F.month(_col(period).getField("end_date"))


def period_quarters(period: str | Column) -> Column:
    """Quarter indexes a period covers, as ``array<int>`` (F-6)."""
    p = _col(period)
    return F.sequence(
        quarter_index_of_date(p.getField("start_date")),
        quarter_index_of_date(p.getField("end_date")),
    )
