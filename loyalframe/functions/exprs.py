"""Column-expression helpers shared by every dataset.

All helpers return built-in Spark expressions, so they stay inside
whole-stage codegen. Rounding is done on exact integers (decimal(38,0)),
never on a double that has already lost digits, so a share such as
1 of 800 rounds the same way on every engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from loyalframe.config import MINUTE_FORMAT, MONTH_FORMAT

_EXACT = "decimal(38,0)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _q(x: str) -> str:
    """A column name as a SQL identifier; other SQL text passes through."""
    return f"`{x}`" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", x) else f"({x})"


def idiv(a, b) -> Column:
    """Integer division truncating toward zero; NULL when ``b`` is 0."""
    if isinstance(a, str) and isinstance(b, str):
        return F.expr(f"{_q(a)} div nullif({_q(b)}, 0)")
    return F.call_function("div", col(a), F.nullif(col(b), F.lit(0)))


def round_div_sql(num: str, den: str, scale: int = 2, half_even: bool = False, times: int = 1) -> str:
    """SQL text of :func:`round_div` of ``num * times`` for column names / SQL snippets.

    Operands whose products fit a bigint, as nearly all do, are divided as
    bigints; decimals, exact too but many times slower, are left to the rest.
    """
    p = f"(cast({_q(num)} as {_EXACT}) * {times})" if times != 1 else f"cast({_q(num)} as {_EXACT})"
    q = f"nullif(cast({_q(den)} as {_EXACT}), 0)"
    k = 10**scale
    if half_even:
        n = f"({p} * {k})"
        base = f"({n} div {q})"
        rem2 = f"(({n} - {base} * {q}) * 2)"
        r = f"({base} + CASE WHEN {rem2} > {q} OR ({rem2} = {q} AND {base} % 2 = 1) THEN 1 ELSE 0 END)"
    else:
        mag = f"((abs({p}) * {2 * k} + {q}) div ({q} * 2))"
        r = f"(CASE WHEN {p} < 0 THEN -{mag} ELSE {mag} END)"
    exact = f"({r} / {float(k)!r}D)"
    if half_even:
        return exact
    n, d = f"try_cast({_q(num)} as bigint)", f"try_cast({_q(den)} as bigint)"
    small = f"{n} BETWEEN {-10**17 // (k * times)}L AND {10**17 // (k * times)}L AND {d} BETWEEN 1L AND {10**17}L"
    mag = f"((abs({n}) * {2 * k * times}L + {d}) div ({d} * 2L))"
    return f"(CASE WHEN {small} THEN (CASE WHEN {n} < 0 THEN -{mag} ELSE {mag} END) / {float(k)!r}D ELSE {exact} END)"


def _half_up(p: Column, q: Column, scale: int) -> Column:
    # round(p / q, scale) half away from zero, q > 0, exact
    two_k = 2 * 10**scale
    mag = F.call_function("div", F.abs(p) * two_k + q, q * 2)
    return F.when(p < 0, -mag).otherwise(mag)


def _half_even(p: Column, q: Column, scale: int) -> Column:
    # round(p / q, scale) half to even, p >= 0, q > 0, exact
    n = p * (10**scale)
    base = F.call_function("div", n, q)
    twice_rem = (n - base * q) * 2
    bump = F.when(twice_rem > q, 1).when((twice_rem == q) & (base % 2 == 1), 1).otherwise(0)
    return base + bump


def round_div(num, den, scale: int = 2, half_even: bool = False) -> Column:
    """``round(num / den, scale)`` computed exactly, as a double; NULL if den is 0.

    ``num`` and ``den`` must be integral (long or decimal(x,0)): column
    names / SQL text (built as one SQL expression) or Columns. Half away
    from zero by default (SQL ROUND); ``half_even`` for the banker's
    rounding Python's ``round`` applies.
    """
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(round_div_sql(num, den, scale, half_even))
    p = col(num).cast(_EXACT)
    q = F.nullif(col(den).cast(_EXACT), F.lit(0))
    r = _half_even(p, q, scale) if half_even else _half_up(p, q, scale)
    return r / F.lit(float(10**scale))


def pct(num, den, scale: int = 2, half_even: bool = False) -> Column:
    """``round(num * 100 / den, scale)``; NULL when ``den`` is 0."""
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(round_div_sql(num, den, scale, half_even, times=100))
    return round_div(col(num).cast(_EXACT) * 100, den, scale, half_even)


def ratio(a, b, a_type, b_type, truncate: bool = True) -> Column:
    """``a / b`` with the integer rule of the shop's SQL.

    Both integral -> truncating integer division (bigint); otherwise a
    double division. NULL (not an ANSI error) when ``b`` is 0.
    """
    if integer_rule(a_type, b_type, truncate):
        return idiv(a, b)
    if isinstance(a, str) and isinstance(b, str):
        return F.expr(f"try_divide(cast({_q(a)} as double), cast({_q(b)} as double))")
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def whole_ratio(a, b, a_type, b_type, truncate: bool = True) -> Column:
    """:func:`ratio`, rounded to a whole number where it is a real division."""
    r = ratio(a, b, a_type, b_type, truncate)
    return r if integer_rule(a_type, b_type, truncate) else F.round(r, 0)


def integer_rule(a_type, b_type, truncate: bool = True) -> bool:
    """True when ``a / b`` truncates: both operands whole numbers."""
    def whole(t):
        return isinstance(t, IntegralType) or (isinstance(t, DecimalType) and t.scale == 0)
    return truncate and whole(a_type) and whole(b_type)


def minutes_between(later, earlier) -> Column:
    """Whole minutes between two minute-truncated timestamps."""
    if isinstance(later, str) and isinstance(earlier, str):
        return F.expr(f"(unix_timestamp({_q(later)}) - unix_timestamp({_q(earlier)})) div 60")
    return F.call_function(
        "div", F.unix_timestamp(col(later)) - F.unix_timestamp(col(earlier)), F.lit(60)
    )


def days_from_minutes(m) -> Column:
    return col(m) / F.lit(1440.0)


def minute_text(ts) -> Column:
    """Timestamp rendered as the datasets' ``YYYY-MM-DD HH:MM`` text."""
    return F.date_format(col(ts), MINUTE_FORMAT)


def month_text(ts) -> Column:
    return F.date_format(col(ts), MONTH_FORMAT)


def week_ending(ts, weekday: str) -> Column:
    """Label of the pandas weekly bin ``W-<weekday>`` holding ``ts``.

    pandas labels a weekly bin by its closing day and the day itself
    belongs to its own bin: the label is the first ``weekday`` on or
    after the date.
    """
    return F.next_day(F.date_sub(F.to_date(col(ts)), 1), weekday)


def phase_of_month(month, phases) -> Column:
    """Map a ``YYYY-MM`` month text to its phase name."""
    expr = None
    for name, last in phases:
        if last is None:
            expr = F.lit(name) if expr is None else expr.otherwise(F.lit(name))
            break
        cond = col(month) <= F.lit(last)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def customer_kind(acquisition_type) -> Column:
    """'ret' for returning acquisition types, 'new' otherwise."""
    return F.when(F.lower(col(acquisition_type)).contains("return"), F.lit("ret")).otherwise(
        F.lit("new")
    )
