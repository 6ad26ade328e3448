"""Cell parsing for untidy published numbers (F-7 .. F-10, F-17, F-18).

Every parser has a lenient form (unparseable -> null, so a scan can
quarantine bad rows) and, where the reference raised, a strict form that
fails the job with ``raise_error``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of a percentage expression cell, e.g.
# "5.43 / 100 * 2,510,798", and of a percent range such as "4%-5%".
PERCENT_EXPR_PATTERN = r"^(\d+\.\d+)\s*/\s*100\s*\*\s*(\d[\d,]*\d|\d)$"
PERCENT_RANGE_PATTERN = r"^\s*(-?\d+(?:\.\d+)?)\s*%?\s*-\s*(-?\d+(?:\.\d+)?)\s*%\s*$"
INT_PATTERN = r"^[+-]?\d+$"
THOUSANDS_INT_PATTERN = r"^[+-]?\d{1,3}(,\d{3})*$|^[+-]?\d+$"

SCHEMA_TYPES = ("int", "float", "string")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_thousands(c: str | Column) -> Column:
    """``"1,234,567"`` -> ``"1234567"`` (F-7)."""
    return F.regexp_replace(_col(c), ",", "")


def parse_count(c: str | Column, strict: bool = False) -> Column:
    """A count with optional thousands separators as ``bigint``."""
    text = F.trim(_col(c))
    value = strip_thousands(text).try_cast("bigint")
    if strict:
        return F.when(text.isNull() | (text == ""), F.lit(None).cast("bigint")).when(
            value.isNotNull(), value
        ).otherwise(F.raise_error(F.concat(F.lit('invalid count "'), text, F.lit('"'))))
    return value


def parse_number(c: str | Column) -> Column:
    """A decimal number with optional thousands separators as ``double``."""
    return strip_thousands(F.trim(_col(c))).try_cast("double")


def parse_percent(c: str | Column) -> Column:
    """``"0.05%"`` -> ``0.05`` (F-8); percent points, not a fraction."""
    return F.regexp_replace(F.trim(_col(c)), "%$", "").try_cast("double")


def percent_expression(c: str | Column) -> Column:
    """``"5.43 / 100 * 2,510,798"`` -> struct(percent, total, value) (F-9)."""
    text = F.trim(_col(c))
    ok = text.rlike(PERCENT_EXPR_PATTERN)
    percent = F.regexp_extract(text, PERCENT_EXPR_PATTERN, 1).cast("double")
    total = strip_thousands(F.regexp_extract(text, PERCENT_EXPR_PATTERN, 2)).cast("bigint")
    return F.when(
        ok,
        F.struct(
            percent.alias("percent"),
            total.alias("total"),
            (percent / 100.0 * total).alias("value"),
        ),
    )


def range_midpoint(c: str | Column) -> Column:
    """``"4%-5%"`` -> ``4.5``: the midpoint of a percent range (F-10)."""
    text = _col(c)
    lo = F.regexp_extract(text, PERCENT_RANGE_PATTERN, 1).cast("double")
    hi = F.regexp_extract(text, PERCENT_RANGE_PATTERN, 2).cast("double")
    return F.when(text.rlike(PERCENT_RANGE_PATTERN), (lo + hi) / 2.0)


def parse_measure(c: str | Column) -> Column:
    """Any published measure: count, plain number, percent, percent range or
    percentage expression, first match wins; null when none applies."""
    text = F.trim(_col(c))
    return F.coalesce(
        percent_expression(text).getField("value"),
        range_midpoint(text),
        F.when(text.endswith("%"), parse_percent(text)),
        parse_number(text),
    )


def typed_cell(c: str | Column, type_name: str, strict: bool = False) -> Column:
    """Type one raw cell by its declared schema entry (S-10).

    ``int`` accepts integers only; ``float`` accepts numbers and percentage
    expressions; ``string`` accepts any text.  JSON quotes around the text
    are ignored and ``null`` stays null.  Numeric results are ``double``.
    """
    raw = F.trim(_col(c))
    text = F.regexp_replace(raw, r'^"(.*)"$', "$1")
    is_null = raw.isNull() | (raw == "null")
    if type_name == "string":
        value, bad = text, F.lit(False)
    elif type_name == "int":
        value = F.when(text.rlike(INT_PATTERN), text.cast("double"))
        bad = ~is_null & ~text.rlike(INT_PATTERN)
    elif type_name == "float":
        value = F.coalesce(text.try_cast("double"), percent_expression(text).getField("value"))
        bad = ~is_null & value.isNull()
    else:
        raise ValueError(f"unknown schema type {type_name!r}")
    if strict:
        return F.when(is_null, F.lit(None)).when(~bad, value).otherwise(
            F.raise_error(F.concat(F.lit(f"cell is not {type_name}: "), raw))
        )
    return F.when(is_null | bad, F.lit(None)).otherwise(value)


def truncate_int(c: str | Column) -> Column:
    """Truncation toward zero to an integer (F-17)."""
    return _col(c).cast("bigint")


# SQL over ``s.a`` (the absolute value), ``s.e`` (its decimal exponent) and
# ``s.j`` (decimals to keep): digits kept as a whole number ``q``, and the sign
# of what is cut off against one half.  A product with a power of ten is taken
# with its rounding error (Dekker's splitting), so the comparison is exact.
_SPLIT = "134217729D"
_HALF_EVEN = f"""element_at(transform(array(case when s.j >= 0 then element_at(transform(array(named_struct(
    'x', s.a, 'y', s.scale, 'p', s.a * s.scale,
    'xh', {_SPLIT} * s.a - ({_SPLIT} * s.a - s.a), 'yh', {_SPLIT} * s.scale - ({_SPLIT} * s.scale - s.scale))),
    v -> named_struct('q', cast(floor(v.p) as double),
        'd', (v.p - floor(v.p) - 0.5D) + (((v.xh * v.yh - v.p) + v.xh * (v.y - v.yh) + (v.x - v.xh) * v.yh)
             + (v.x - v.xh) * (v.y - v.yh)))), 1)
  else named_struct('q', rint((s.a - s.a % s.scale) / s.scale), 'd', s.a % s.scale - s.scale / 2) end),
  r -> case when r.d > 0 or (r.d = 0 and r.q % 2 = 1) then r.q + 1 else r.q end), 1)"""


def round_significant(c: str | Column, digits: int = 3) -> Column:
    """Round to ``digits`` significant digits, the double's exact value, half to even (F-18).

    1245 gives 1240 and 12.45, which is a little less, gives 12.4: the same
    as formatting with that many digits.  Zero, null, NaN and infinities
    pass through.  Exact for magnitudes from 1e-19 up.
    """
    power = "cast(concat('1E', cast({} as string)) as double)".format
    near = "cast(floor(log10(t.a)) as int)"
    exponent = (f"case when {power(f'({near} + 1)')} <= t.a then {near} + 1 "
                f"when {power(near)} > t.a then {near} - 1 else {near} end")
    body = f"""case when t.a = 0 or isnan(t.a) or t.a = double('infinity') then t.x else
        element_at(transform(array({exponent}), e ->
            element_at(transform(array(named_struct('a', t.a, 'j', {digits - 1} - e,
                'scale', {power(f'abs({digits - 1} - e)')})), s ->
            signum(t.x) * case when s.j >= 0 then {_HALF_EVEN} / s.scale else {_HALF_EVEN} * s.scale end), 1)), 1) end"""
    x = _col(c).cast("double")
    held = F.struct(x.alias("x"), F.abs(x).alias("a"))
    return F.when(x.isNotNull(), F.call_function("transform", F.array(held), F.expr(f"t -> {body}"))[0])


def casefold(c: str | Column) -> Column:
    """Lower-case converter used on categorical columns (F-11)."""
    return F.lower(_col(c))
