"""Column expressions: calendar month age, exact rounding."""

from pyspark.sql import functions as F

from cohortlens.functions import age_months, pct, ratio, round_div, round_float_as_numeric
from conftest import d


def test_age_months_calendar_semantics(spark):
    pairs = [("2024-01-31", "2024-02-29", 0), ("2024-01-31", "2024-03-01", 1),
             ("2024-03-01", "2024-01-31", -1), ("2024-03-10", "2024-03-05", 0),
             ("2023-05-15", "2024-05-15", 12), ("2023-05-15", "2024-05-14", 11),
             ("2024-02-29", "2025-02-28", 11), ("2024-02-29", "2025-03-01", 12)]
    df = spark.createDataFrame([(d(a), d(b)) for a, b, _ in pairs], "s date, e date")
    got = [r[0] for r in df.select(age_months(F.col("s"), F.col("e"))).collect()]
    assert got == [m for _, _, m in pairs]
    # floor(months_between) differs on month ends: the reason for age_months
    mb = df.select(F.floor(F.months_between("e", "s"))).collect()[0][0]
    assert mb == 1


def test_pct_rounds_half_away_from_zero_exactly(spark):
    df = spark.createDataFrame([(1, 800), (201, 20000), (-1, 800), (0, 0), (2, 3)], "a long, b long")
    got = [r[0] for r in df.select(pct(F.col("a"), F.col("b"))).collect()]
    assert got == [0.13, 1.01, -0.13, None, 66.67]


def test_round_div_and_ratio(spark):
    df = spark.createDataFrame([(5, 2), (1, 3), (7, 0)], "a long, b long")
    assert [r[0] for r in df.select(round_div(F.col("a"), F.col("b"))).collect()] == [2.5, 0.33, None]
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [2.5, 1 / 3, None]


def test_float_to_numeric_rounding_ignores_ulp_noise(spark):
    df = spark.createDataFrame([(9.424999999999999,), (9.425000000000001,), (2.675,), (None,)], "x double")
    got = [r[0] for r in df.select(round_float_as_numeric(F.col("x"))).collect()]
    assert got == [9.43, 9.43, 2.68, None]
