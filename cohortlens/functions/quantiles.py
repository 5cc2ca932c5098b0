"""Exact interpolated percentiles by merged histograms.

Spark's exact ``percentile`` keeps all values of a group with their counts in
one buffer.  Here the histogram is a table: rows per (group, value), counted in
tasks before the shuffle and shuffled by (group, value), so no task holds a
group's values.  Running counts over the distinct values find the two order
statistics that a percentile lies between; the interpolation is that of
``percentile_cont``.

The running count is a window per group over its distinct values - for whole
days, weeks or months bounded by the calendar.  Values with more distinct
cases than one task should sort are first narrowed down with ``bins``: counts per
bin of equal width find the bins that hold the wanted ranks, and only their
values are counted one by one.  Both ways give the same, exact result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _cumulated(hist: DataFrame, by: list[str], value: str) -> DataFrame:
    group = Window.partitionBy(*by)
    up = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("_upto", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(group))


def _interpolated(low: Column, high: Column, rank: Column) -> Column:
    part = rank - F.floor(rank)
    return low.cast("double") + (high.cast("double") - low.cast("double")) * part


def exact_percentiles(df: DataFrame, by: list[str], value: str, ps: list[float], bins: int | None = None) -> DataFrame:
    """Per group of ``by``: the percentiles ``ps`` of ``value`` (NULLs left out), as
    columns ``p0``, ``p1``, ...; groups without a value are absent."""
    df = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ranks = [F.lit(float(p)) * (F.col("_all") - 1) for p in ps]
    if bins is None:
        cum = _cumulated(df.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), by, "_v")
        found = []
        for rank in ranks:
            found += [F.min(F.when(F.col("_upto") > k, F.col("_v"))) for k in (F.floor(rank), F.ceil(rank))]
        stats = cum.groupBy(*by).agg(F.max("_all").alias("_all"), *[f.alias(f"_s{i}") for i, f in enumerate(found)])
        return stats.select(*by, *[_interpolated(F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}"), rank).alias(f"p{i}")
                                   for i, rank in enumerate(ranks)])
    span = df.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    width = (F.col("_high").cast("double") - F.col("_low").cast("double")) / bins
    number = F.when(width > 0, F.least(F.floor((F.col("_v").cast("double") - F.col("_low").cast("double")) / width),
                                       F.lit(bins - 1))).otherwise(0)
    binned = df.join(span, by).select(*by, "_v", number.cast("long").alias("_bin"))
    cum = _cumulated(binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n")), by, "_bin")
    wanted = F.lit(False)
    for rank in ranks:
        for k in (F.floor(rank), F.ceil(rank)):
            wanted = wanted | ((F.col("_upto") > k) & (F.col("_upto") - F.col("_n") <= k))
    holders = cum.where(wanted).select(*by, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_all")
    fine = (binned.join(holders, [*by, "_bin"]).groupBy(*by, "_bin", "_before", "_all", "_v")
            .agg(F.count(F.lit(1)).alias("_n")))
    inside = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = fine.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    found = []
    for rank in ranks:
        found += [F.min(F.when(F.col("_upto") > k, F.col("_v"))) for k in (F.floor(rank), F.ceil(rank))]
    stats = fine.groupBy(*by).agg(F.max("_all").alias("_all"), *[f.alias(f"_s{i}") for i, f in enumerate(found)])
    return stats.select(*by, *[_interpolated(F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}"), rank).alias(f"p{i}")
                               for i, rank in enumerate(ranks)])
