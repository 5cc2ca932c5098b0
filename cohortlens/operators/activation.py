"""Activation funnel (J16), median time to activation (J17), first-use data
quality (J18) and its two-column projection (J34).

All four read the same per-account funnel row: signup date, first
subscription start, first usage.  First usage is reduced per subscription
before the join (one row per subscription, however many usage rows), and the
three per-account inputs are joined co-partitioned on account_id.  The
outputs are global aggregates: partial per task, one final row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions import days_between, ratio, round_div
from cohortlens.sources.tables import Tables

# Funnel step names of the source, in output order.
STEPS = ("subscription", "usage", "usage_from_subscription")


def activation_base(t: Tables) -> DataFrame:
    """account_id, signup_date, first_subscription, first_usage."""
    first_sub = t.pick("subscriptions", "account_id", "start_date").groupBy("account_id") \
        .agg(F.min("start_date").alias("first_subscription"))
    first_use = (t.pick("feature_usage", "subscription_id", "usage_date").groupBy("subscription_id").agg(F.min("usage_date").alias("u"))
                 .join(t.pick("subscriptions", "subscription_id", "account_id"), "subscription_id")
                 .groupBy("account_id").agg(F.min("u").alias("first_usage")))
    return (t.pick("accounts", "account_id", "signup_date")
            .join(first_sub, "account_id", "left")
            .join(first_use, "account_id", "left"))


def _mean_days(start: str, end: str):
    days = days_between(F.col(start), F.col(end))
    keep = F.col(end) >= F.col(start)
    return round_div(F.sum(F.when(keep, days)), F.count(F.when(keep, days)))


def activation_funnel(base: DataFrame) -> DataFrame:
    """Three rows (funnel, conversion, avg_activation_time_days)."""
    n_all = F.count(F.lit(1))
    n_sub, n_use = F.count("first_subscription"), F.count("first_usage")
    one = base.agg(
        ratio(n_sub, n_all).alias("c1"), _mean_days("signup_date", "first_subscription").alias("a1"),
        ratio(n_use, n_all).alias("c2"), _mean_days("signup_date", "first_usage").alias("a2"),
        ratio(n_use, n_sub).alias("c3"), _mean_days("first_subscription", "first_usage").alias("a3"))
    args = []
    for i, step in enumerate(STEPS, start=1):
        args += [F.lit(step), F.col(f"c{i}"), F.col(f"a{i}")]
    return one.select(F.stack(F.lit(len(STEPS)), *args)
                      .alias("funnel", "conversion", "avg_activation_time_days"))


def activation_median(base: DataFrame, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Exact (interpolated) median days from signup to first
    subscription and to first use, over accounts where that step is not
    before the signup.  Spark's exact percentile keeps a value -> count map,
    bounded by the number of distinct day counts, not by rows.
    ``approx=True`` uses ``percentile_approx`` (no interpolation: returns an
    observed value)."""
    def med(end: str):
        days = F.when(F.col(end) >= F.col("signup_date"), days_between(F.col("signup_date"), F.col(end)))
        if approx:
            return F.percentile_approx(days, 0.5, accuracy).cast("double")
        return F.percentile(days, F.lit(0.5))
    return base.agg(med("first_subscription").alias("median_subscription_from_signup_time_days"),
                    med("first_usage").alias("median_usage_from_signup_time_days"))


def activation_median_by_histogram(base: DataFrame) -> DataFrame:
    """J17 with the histogram of days as a table instead of one buffer
    (``exact_percentiles``): the same exact medians.  NULL where no account
    has that step."""
    from cohortlens.functions.quantiles import exact_percentiles
    days = lambda end: F.when(F.col(end) >= F.col("signup_date"),
                              days_between(F.col("signup_date"), F.col(end)))
    long = base.select(F.stack(F.lit(2), F.lit("s"), days("first_subscription"), F.lit("u"), days("first_usage"))
                       .alias("step", "days"))
    medians = exact_percentiles(long, ["step"], "days", [0.5])
    of = lambda step, name: F.max(F.when(F.col("step") == step, F.col("p0"))).alias(name)
    return medians.agg(of("s", "median_subscription_from_signup_time_days"),
                       of("u", "median_usage_from_signup_time_days"))


def usage_quality(base: DataFrame) -> DataFrame:
    """Accounts, and accounts whose first use is on/after (valid) or
    before (invalid) the signup; accounts without use are in neither."""
    fu, su = F.col("first_usage"), F.col("signup_date")
    return base.agg(F.count(F.lit(1)).alias("total_count"),
                    F.count(F.when(fu >= su, F.col("account_id"))).alias("valid_usage_data"),
                    F.count(F.when(fu < su, F.col("account_id"))).alias("invalid_usage_data"))


def usage_quality_split(quality: DataFrame) -> DataFrame:
    """The valid / invalid columns only."""
    return quality.select("valid_usage_data", "invalid_usage_data")
