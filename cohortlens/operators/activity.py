"""Monthly active users (J15) and its published summary figures.

An account is active in a month when it used any feature on a day that is
on/after its signup date and not after its churn.  With several churn events
the source's join fans out and the distinct count keeps a use when it is on
or before *any* churn date, i.e. on or before the *last* one; an event with
a NULL date lifts the bound entirely.  Here that is one pre-aggregated row
per account (last churn date, any NULL date) instead of a fan-out join.

Plan: usage -> distinct (subscription, day) [map-side combine; a hot
subscription collapses] -> join subscriptions enriched with signup and the
churn bound [on subscription_id; the enrichment itself is a skew-safe lookup
join on account_id, so an account owning a third of all subscriptions is
salted over many tasks] -> filter -> distinct (month, account) -> count per
month.  The distinct count is planned by Catalyst as two
partially aggregated exchanges keyed by (month, account), so one busy month
is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions import month_of, round_div
from cohortlens.operators.skew import lookup_join
from cohortlens.sources.tables import Tables


def account_activity_bounds(t: Tables) -> DataFrame:
    """account_id, signup_date and active_until (NULL = no upper bound)."""
    churn = (t.pick("churn_events", "account_id", "churn_date").groupBy("account_id")
             .agg(F.max("churn_date").alias("last_churn_date"),
                  F.max(F.col("churn_date").isNull()).alias("null_churn_date")))
    until = F.when(F.col("null_churn_date"), F.lit(None)).otherwise(F.col("last_churn_date"))
    return (t.pick("accounts", "account_id", "signup_date")
            .join(churn, "account_id", "left")
            .select("account_id", "signup_date", until.alias("active_until")))


def active_days(t: Tables) -> DataFrame:
    """account_id, usage_date of the uses that count, each (subscription, day) once."""
    days = t.pick("feature_usage", "subscription_id", "usage_date").distinct()
    subs = lookup_join(t.pick("subscriptions", "subscription_id", "account_id"),
                       account_activity_bounds(t), "account_id", "inner", hot=t.hot_accounts)
    d, until = F.col("usage_date"), F.col("active_until")
    return (days.join(subs, "subscription_id")
            .where((d >= F.col("signup_date")) & (until.isNull() | (d <= until)))
            .select("account_id", "usage_date"))


def monthly_active_users(t: Tables, approx: bool = False, rsd: float = 0.01,
                         ordered: bool = True) -> DataFrame:
    """active_month, mau.  ``approx=True`` counts accounts with
    HyperLogLog++ (relative error ``rsd``): one partial aggregate per month,
    no exchange keyed by account."""
    count = F.approx_count_distinct("account_id", rsd) if approx else F.count_distinct("account_id")
    out = active_days(t).groupBy(month_of(F.col("usage_date")).alias("active_month")).agg(count.alias("mau"))
    return out.orderBy(F.col("active_month").asc_nulls_last()) if ordered else out


def mau_summary(mau: DataFrame) -> DataFrame:
    """Mean MAU over the months (2 decimals), the peak month (earliest
    on ties) and its MAU."""
    peak = F.min_by(F.struct(F.col("active_month").alias("m"), F.col("mau").alias("v")),
                    F.struct(-F.col("mau"), F.col("active_month")))
    return (mau.agg(round_div(F.sum("mau"), F.count("mau")).alias("mean_mau"), peak.alias("p"))
            .select("mean_mau", F.col("p.m").alias("peak_month"), F.col("p.v").alias("peak_mau")))
