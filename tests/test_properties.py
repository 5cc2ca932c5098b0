"""Property tests of the shared column expressions against plain-Python
references (many generated cases per Spark job)."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.functions import age_months, pct, round_float_as_numeric

DATES = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2040, 12, 31))


def py_age_months(start: dt.date, end: dt.date) -> int:
    """Whole months of the calendar age from start to end (negated when end < start)."""
    if end < start:
        return -py_age_months(end, start)
    months = (end.year - start.year) * 12 + end.month - start.month
    return months - (1 if end.day < start.day else 0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(DATES, DATES), min_size=1, max_size=300))
def test_age_months_matches_calendar_arithmetic(spark, pairs):
    df = spark.createDataFrame(pairs, "s date, e date")
    got = [r[0] for r in df.select(age_months(F.col("s"), F.col("e"))).collect()]
    assert got == [py_age_months(s, e) for s, e in pairs]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(1, 10**9)), min_size=1, max_size=300))
def test_pct_is_exact_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [r[0] for r in df.select(pct(F.col("a"), F.col("b"))).collect()]
    want = [float((Decimal(a) * 100 / Decimal(b)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
            for a, b in pairs]
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=300))
def test_float_rounding_uses_15_significant_digits(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(round_float_as_numeric(F.col("x"))).collect()]
    want = [float(Decimal(f"{x:.15g}").quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)) for x in xs]
    assert got == want
