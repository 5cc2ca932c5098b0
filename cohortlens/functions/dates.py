"""Date arithmetic with the source system's semantics.

``age_months(start, end)`` is the whole-month part of the calendar age from
``start`` to ``end`` (years * 12 + months of the symbolic age):

* a month is complete only when the day of month is reached again, so
  31 Jan -> 29 Feb is 0 months and 31 Jan -> 1 Mar is 1 month;
* for ``end < start`` the age is the negated age from ``end`` to ``start``.

This is *not* ``floor(months_between(end, start))``, which treats two
month-end days as a whole month.  Written with year/month/day arithmetic so it
stays a plain codegen'd expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _forward_months(start: Column, end: Column) -> Column:
    raw = (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))
    return raw - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)


def age_months(start: Column, end: Column) -> Column:
    return F.when(end >= start, _forward_months(start, end)) \
        .otherwise(-_forward_months(end, start))


def month_of(d: Column) -> Column:
    """First day of the month, kept as a DATE (``trunc``; ``date_trunc``
    would return a timestamp)."""
    return F.trunc(d, "MM")


def month_spine(df: DataFrame, month: str) -> DataFrame:
    """``month``: every month from the first to the last in column ``month`` of
    ``df``, none left out (no row if it has none).  One aggregate, then at most a
    row per calendar month."""
    span = df.agg(F.min(month).alias("_first"), F.max(month).alias("_last"))
    months = F.sequence("_first", "_last", F.expr("interval 1 month"))
    return span.where(F.col("_first").isNotNull()).select(F.explode(months).alias(month))


def days_between(start: Column, end: Column) -> Column:
    """``end - start`` in days, as the source's date subtraction."""
    return F.datediff(end, start)
