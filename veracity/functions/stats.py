"""Exact test statistics as Spark expressions (A-24, A-25).

Spark SQL has no gamma function.  Probabilities of the binomial and the
hypergeometric distribution come from the saddle-point form of Loader (2000):
Stirling's series for the factorials and a deviance that keeps its digits, so
nothing cancels however large the counts are.  A tail is summed from its
largest term outwards, each term by the ratio to the one before, and stops
where terms no longer count: about a dozen standard deviations, in chunks of
``CHUNK`` terms.  Counts in the billions need neither an array as long as the
count nor more memory than a few thousand numbers a row.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 512
DEVIATIONS = 12
_SMALL = 16  # below, Stirling's error is looked up
# ln(n!) minus Stirling's leading terms, for n below _SMALL (0 has no use for it).
_ERRORS = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, _SMALL)]
_TWO_PI = f"{2 * math.pi!r}D"
_EQUAL = f"{math.log1p(1e-7)!r}D"

# Expressions are SQL text: building them call by call costs seconds.
_names = count()


def _col(c: str | Column | int | float) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def _let(body: str, name: str, **values: str) -> str:
    """SQL of ``body`` over a struct ``name`` whose values are computed once."""
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"


def _over(body: str, **values: str | Column | int | float) -> Column:
    """``body``, SQL over a struct ``s`` of the given columns as doubles."""
    held = F.struct(*[_col(v).cast("double").alias(k) for k, v in values.items()])
    return F.call_function("transform", F.array(held), F.expr(f"s -> {body}"))[0]


def _stirling_error(n: str) -> str:
    table = ", ".join(f"{x!r}D" for x in _ERRORS)
    r = f"(1D / {n})"
    series = f"{r} * (1D/12 - {r} * {r} * (1D/360 - {r} * {r} * (1D/1260 - {r} * {r} * (1D/1680 - {r} * {r} / 1188))))"
    return f"(case when {n} < {_SMALL} then element_at(array({table}), cast({n} as int) + 1) else {series} end)"


def _deviance(x: str, mean: str) -> str:
    """``x ln(x / mean) + mean - x`` without cancellation near the mean."""
    v = f"v{next(_names)}"
    tail = "0D"
    for j in range(12, 0, -1):
        tail = f"{v}.v * {v}.v * (1D / {2 * j + 1} + {tail})"
    near = f"({v}.x - {v}.m) * {v}.v + 2 * {v}.x * {v}.v * {tail}"
    return _let(f"case when abs({v}.v) < 0.1D then {near} else {v}.x * ln({v}.x / {v}.m) + {v}.m - {v}.x end", v,
                x=x, m=mean, v=f"({x} - {mean}) / ({x} + {mean})")


def _log_factorial(n: str) -> str:
    return f"(case when {n} < 1 then 0D else ({n} + 0.5D) * ln({n}) - {n} + 0.5D * ln({_TWO_PI}) + {_stirling_error(n)} end)"


def log_factorial(n: str | Column | int) -> Column:
    """ln(n!) for n >= 0."""
    return _over(_log_factorial("s.n"), n=n)


def log_choose(n, k) -> Column:
    return _over(f"{_log_factorial('s.n')} - {_log_factorial('s.k')} - {_log_factorial('s.r')}", n=n, k=k, r=_col(n) - _col(k))


def _log_binomial(k: str, n: str, p: str, q: str) -> str:
    """ln P(X = k) for X ~ Binomial(n, p), q = 1 - p, 0 < p < 1."""
    b = f"b{next(_names)}"
    inner = (f"{_stirling_error(f'{b}.n')} - {_stirling_error(f'{b}.k')} - {_stirling_error(f'{b}.r')} "
             f"- {_deviance(f'{b}.k', f'{b}.n * {b}.p')} - {_deviance(f'{b}.r', f'{b}.n * {b}.q')} "
             f"+ 0.5D * ln({b}.n / ({_TWO_PI} * {b}.k * {b}.r))")
    return _let(f"case when {b}.k = 0 then {b}.n * log1p(-{b}.p) when {b}.r = 0 then {b}.n * ln({b}.p) else {inner} end", b,
                k=k, n=n, p=p, q=q, r=f"({n}) - ({k})")


def _series(start: str, ratio: str, step: int, deviation: str) -> str:
    """``1 + r(start) + r(start) r(start + step) + ..`` until terms no longer count; ``ratio`` is SQL over ``t.x``."""
    term = (f"(t, i) -> case when t.t < t.s * 1e-20D then t else "
            f"named_struct('x', t.x + {step}, 't', t.t * {ratio}, 's', t.s + t.t * {ratio}) end")
    first = f"named_struct('x', {start}, 't', 1D, 's', 1D)"
    chunks = f"sequence(1, cast(ceil(({DEVIATIONS} * {deviation} + 64) / {CHUNK}) as int))"
    return f"aggregate({chunks}, {first}, (c, o) -> aggregate(sequence(1, {CHUNK}), c, {term}), c -> c.s)"


def binomial_upper_tail(k, n, p=0.5) -> Column:
    """P(X >= k) for X ~ Binomial(n, p), 0 < p < 1: the one-sided ("greater") sign test."""
    up = f"exp({_log_binomial('s.k', 's.n', 's.p', 's.q')}) * {_series('s.k', '(s.n - t.x) / (t.x + 1) * (s.p / s.q)', 1, 's.sd')}"
    down = (f"exp({_log_binomial('s.k - 1', 's.n', 's.p', 's.q')}) * "
            f"{_series('s.k - 1', 't.x / (s.n - t.x + 1) * (s.q / s.p)', -1, 's.sd')}")
    n, p = _col(n).cast("double"), _col(p).cast("double")
    return _over(f"case when s.k <= 0 then 1D when s.k > s.n then 0D when s.k > s.n * s.p then least({up}, 1D) "
                 f"else greatest(1 - {down}, 0D) end", k=k, n=n, p=p, q=1 - p, sd=F.sqrt(n * p * (1 - p)))


def _margins(a, b, c, d) -> dict[str, Column]:
    """Margins of the table [[a, b], [c, d]]: drawn ``k`` of ``n``, ``m`` of them marked."""
    a, b, c, d = (_col(x).cast("double") for x in (a, b, c, d))
    m, k, n = a + c, a + b, a + b + c + d
    variance = F.try_divide(k * m, n) * (1 - F.try_divide(m, n)) * F.try_divide(n - k, F.greatest(n - 1, F.lit(1.0)))
    return {"a": a, "m": m, "k": k, "n": n, "lo": F.greatest(F.lit(0.0), k + m - n), "hi": F.least(m, k),
            "sd": F.sqrt(F.greatest(F.coalesce(variance, F.lit(0.0)), F.lit(0.0)))}


def _log_hypergeometric(x: str) -> str:
    p, q = "s.k / s.n", "(s.n - s.k) / s.n"
    return (f"({_log_binomial(x, 's.m', p, q)} + {_log_binomial(f's.k - ({x})', 's.n - s.m', p, q)} "
            f"- {_log_binomial('s.k', 's.n', p, q)})")


_UP = "(s.m - t.x) * (s.k - t.x) / ((t.x + 1) * (s.n - s.m - s.k + t.x + 1))"
_DOWN = "t.x * (s.n - s.m - s.k + t.x) / ((s.m - t.x + 1) * (s.k - t.x + 1))"


def _tail(x: str, step: int) -> str:
    """P(X >= x) (step 1) or P(X <= x) (step -1) as a sum from ``x`` away from the mode."""
    return f"exp({_log_hypergeometric(x)}) * {_series(x, _UP if step > 0 else _DOWN, step, 's.sd')}"


def hypergeometric_upper_tail(a, b, c, d) -> Column:
    """One-sided ("greater") Fisher exact p for the 2x2 table [[a, b], [c, d]].

    With margins m = a + c (first column), k = a + b (first row) and
    N = a + b + c + d, returns P(X >= a) for X ~ Hypergeometric(N, m, k).
    """
    return _over(f"case when s.a <= s.lo then 1D when s.a * s.n > s.m * s.k then least({_tail('s.a', 1)}, 1D) "
                 f"else greatest(1 - {_tail('s.a - 1', -1)}, 0D) end", **_margins(a, b, c, d))


def fisher_two_sided(a, b, c, d) -> Column:
    """Two-sided Fisher exact p: all tables with the margins of [[a, b], [c, d]] that are no likelier.

    Probabilities within 1e-7 of the table's own count as equal, as is usual.
    The far tail begins at the last place, going from its end to the mode,
    that is no likelier than the table; halving finds it.
    """
    middle = "(case when h.inn > h.out then floor((h.inn + h.out) / 2) else ceil((h.inn + h.out) / 2) end)"
    halve = (f"case when abs(h.inn - h.out) <= 1 then h else " + _let(
        f"case when {_log_hypergeometric('g.x')} <= w.own + {_EQUAL} then named_struct('out', g.x, 'inn', h.inn) "
        f"else named_struct('out', h.out, 'inn', g.x) end", "g", x=f"cast({middle} as double)") + " end")
    far = (f"aggregate(sequence(1, 64), named_struct('out', case when s.a > w.mode then s.lo - 1 else s.hi + 1 end, 'inn', w.mode), "
           f"(h, i) -> {halve}, h -> h.out)")
    both = _let(f"least(case when s.a > w.mode then {_tail('s.a', 1)} + case when f.x >= s.lo then {_tail('f.x', -1)} else 0D end "
                f"else {_tail('s.a', -1)} + case when f.x <= s.hi then {_tail('f.x', 1)} else 0D end end, 1D)", "f", x=far)
    found = _let(f"case when {_log_hypergeometric('w.mode')} <= w.own + {_EQUAL} then 1D else {both} end", "w",
                 mode="cast(floor((s.m + 1) * (s.k + 1) / (s.n + 2)) as double)", own=_log_hypergeometric("s.a"))
    return _over(f"case when s.lo = s.hi then 1D else {found} end", **_margins(a, b, c, d))
