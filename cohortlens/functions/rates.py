"""Rates and rounding with the source system's exact-decimal semantics.

The reference computes percentages on arbitrary-precision decimals and rounds
half away from zero; binary doubles would turn 201 * 100 / 20000 = 1.005 into
1.00.  Here ratios are computed on ``DECIMAL`` (scale >= 14 for counts below
10^12, far more than two-decimal rounding needs) and cast to DOUBLE only as
the last step, so the published value is the double nearest to the exactly
rounded decimal.  Division by zero gives NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_INT = "decimal(19,0)"


def _dec(c: Column) -> Column:
    return c.cast(_INT)


def to_double(c: Column) -> Column:
    return c.cast("double")


def round_div(num: Column, den: Column, scale: int = 2, times: int = 1, num_scale: int = 0) -> Column:
    """round(num * times / den, scale) on decimals, half away from zero, as DOUBLE.

    ``den`` is integral (a count); ``num`` is integral or a decimal with at
    most ``num_scale`` fractional digits (money)."""
    n = num.cast(f"decimal({19 + num_scale},{num_scale})") if num_scale else _dec(num)
    if times != 1:
        n = n * F.lit(times).cast(f"decimal({len(str(times))},0)")
    q = n / _dec(F.nullif(den, F.lit(0)))
    return to_double(F.round(q, scale))


def pct(num: Column, den: Column, scale: int = 2) -> Column:
    """Percentage ``round(num / den * 100, scale)``."""
    return round_div(num, den, scale, times=100)


def ratio(num: Column, den: Column) -> Column:
    """Unrounded ratio as DOUBLE: the IEEE quotient of the two exact integers,
    i.e. the double nearest the exact decimal ratio."""
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


def round_float_as_numeric(x: Column, scale: int = 2) -> Column:
    """``round(x::numeric, scale)`` for a DOUBLE ``x``.

    The float-to-numeric cast keeps 15 significant digits, so ulp noise from
    the order of a floating-point sum (9.424999999999999 vs 9.425000000000001)
    never decides a half-way rounding."""
    as_text = F.format_string("%.15g", x)
    exact = F.when(x.isNotNull(), as_text).try_cast("decimal(38,18)")
    return to_double(F.round(exact, scale))
