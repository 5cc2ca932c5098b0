"""Growth of customers and subscriptions (J13, J14) and the notebook's month
label and trend label (J25, J26).

Plan shape: the only large input is ``subscriptions``; it is reduced to one
row per account (J13) or per month (J14) by a partially aggregated group-by
(map-side combine, so a hot account or month never reaches one task as raw
rows).  The running totals and the lag then run as windows over the month
rows only - at most one row per calendar month, so the single-partition
window is bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions import month_of, month_spine, pct


def _by_month():
    """Window over month rows: ascending, NULL month last (source ordering)."""
    return Window.orderBy(F.col("month").asc_nulls_last())


def _running():
    return _by_month().rowsBetween(Window.unboundedPreceding, Window.currentRow)

PLANS = ("Basic", "Pro", "Enterprise")


def customer_growth(subscriptions: DataFrame, fill_gaps: bool = False) -> DataFrame:
    """New customers per month of their first subscription, running
    total, and month-over-month change in percent.

    Months without new customers have no row, so the change is measured
    against the previous month that has one.  With ``fill_gaps`` every month from
    the first to the last has a row: no new customers count 0, a change is that
    against the month before, and is NULL after a month of none."""
    first = (subscriptions.groupBy("account_id")
             .agg(F.min("start_date").alias("first_start_date")))
    per_month = (first.groupBy(month_of(F.col("first_start_date")).alias("month"))
                 .agg(F.count("account_id").alias("new_customers")))
    if fill_gaps:
        undated = per_month.where("month is null")
        per_month = (month_spine(per_month, "month").join(per_month, "month", "left")
                     .select("month", F.coalesce("new_customers", F.lit(0)).alias("new_customers")).unionByName(undated))
    prev = F.lag("new_customers").over(_by_month())
    return (per_month
            .select(
                "month",
                "new_customers",
                F.sum("new_customers").over(_running()).alias("running_total_new_customers"),
                pct(F.col("new_customers") - prev, prev).alias("mom_growth_percentage"))
            .orderBy(F.col("month").asc_nulls_last()))


def subscription_growth(subscriptions: DataFrame, plans=PLANS) -> DataFrame:
    """New subscriptions per start month, in total and per plan tier,
    each with its running total."""
    plan = F.col("plan_tier")
    counts = [F.count("subscription_id").alias("new_subscriptions")]
    counts += [F.count(F.when(plan == p, F.lit(1))).alias(f"new_{p.lower()}") for p in plans]
    per_month = subscriptions.groupBy(month_of(F.col("start_date")).alias("month")).agg(*counts)
    cols = ["month"]
    for c, run in [("new_subscriptions", "running_new_subscriptions")] + \
            [(f"new_{p.lower()}", f"running_new_{p.lower()}") for p in plans]:
        cols += [F.col(c), F.sum(c).over(_running()).alias(run)]
    return per_month.select(*cols).orderBy(F.col("month").asc_nulls_last())


def month_labels(df: DataFrame, date_col: str = "month", label_col: str | None = None) -> DataFrame:
    """``YYYY-MM`` label of a month column."""
    return df.withColumn(label_col or f"{date_col}_short", F.date_format(F.col(date_col), "yyyy-MM"))


def mom_trend(growth: DataFrame) -> DataFrame:
    """J26: 'negative' below zero, otherwise 'positive' - including the first
    month, whose change is NULL."""
    return growth.withColumn(
        "trend",
        F.when(F.col("mom_growth_percentage") < 0, F.lit("negative")).otherwise(F.lit("positive")))
