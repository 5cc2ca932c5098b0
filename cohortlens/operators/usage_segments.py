"""Usage segments against churn and lifetime.

Each account's usage in its first ``window_days`` after signup (by default
with no lower bound: usage dated before the signup counts too, as in the
source) is banded into no / low / medium / high usage; per band: accounts,
share of all accounts, churned accounts, churn rate and mean lifetime.

Plan: usage is summed per (subscription, day) first - a hot subscription
collapses map-side - then joined to subscriptions and to the accounts' signup
date; the window condition is a filter after an equi-join (no range join).
Churn flag and lifetime ride along in the per-account row, so the band
aggregation is one more partially aggregated group-by with four groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions import pct, round_div
from cohortlens.operators.skew import lookup_join
from cohortlens.sources.tables import Tables

# Band names and limits of the source, in output order.
NO_USAGE, LOW, MEDIUM, HIGH = "no_usage", "low usage", "medium usage", "high usage"
BAND_ORDER = (NO_USAGE, LOW, MEDIUM, HIGH)
DEFAULT_LIMITS = (300, 700)
DEFAULT_WINDOW_DAYS = 60
LOWER_BOUNDS = (None, "signup")


def early_usage(t: Tables, window_days: int = DEFAULT_WINDOW_DAYS,
                lower_bound: str | None = None, signups: DataFrame | None = None) -> DataFrame:
    """account_id, total_usage within the window (accounts with usage only).

    ``signups`` (account_id, signup_date) defaults to the accounts table; the
    segment job passes its per-account outcomes, which are already
    partitioned by account_id, so accounts are not mapped a second time."""
    if lower_bound not in LOWER_BOUNDS:
        raise ValueError(f"lower_bound must be one of {LOWER_BOUNDS}")
    per_day = (t.pick("feature_usage", "subscription_id", "usage_date", "usage_count").groupBy("subscription_id", "usage_date")
               .agg(F.sum("usage_count").alias("uc")))
    signup = F.col("signup_date")
    cond = F.col("usage_date") <= F.date_add(signup, window_days)
    if lower_bound == "signup":
        cond = cond & (F.col("usage_date") >= signup)
    signups = t.pick("accounts", "account_id", "signup_date") if signups is None else signups
    subs = lookup_join(t.pick("subscriptions", "subscription_id", "account_id"),
                       signups.select("account_id", "signup_date"), "account_id", "inner", hot=t.hot_accounts)
    return (per_day.join(subs, "subscription_id").where(cond)
            .groupBy("account_id").agg(F.sum("uc").alias("total_usage")))


def usage_segments(t: Tables, outcomes: DataFrame, limits=DEFAULT_LIMITS,
                   window_days: int = DEFAULT_WINDOW_DAYS,
                   lower_bound: str | None = None) -> DataFrame:
    """J24.  ``outcomes``: one row per account with signup_date, churn_flag
    and lifetime_months_till_churn (``accounts.account_outcomes`` or the
    persisted summary)."""
    low, high = limits
    usage = F.coalesce(F.col("total_usage"), F.lit(0))
    band = (F.when(usage == 0, F.lit(NO_USAGE)).when(usage < low, F.lit(LOW))
            .when(usage < high, F.lit(MEDIUM)).otherwise(F.lit(HIGH)))
    per_band = (outcomes.select("account_id", "churn_flag", "lifetime_months_till_churn")
                .join(early_usage(t, window_days, lower_bound, outcomes), "account_id", "left")
                .groupBy(band.alias("usage_segment"))
                .agg(F.count(F.lit(1)).alias("accounts"),
                     F.sum("churn_flag").cast("long").alias("churned_accounts"),
                     F.sum("lifetime_months_till_churn").alias("life_sum"),
                     F.count("lifetime_months_till_churn").alias("life_n")))
    total = F.sum("accounts").over(Window.partitionBy())  # at most four rows
    order = F.array_position(F.array(*[F.lit(b) for b in BAND_ORDER]), F.col("usage_segment"))
    return (per_band
            .select("usage_segment", "accounts",
                    pct(F.col("accounts"), total).alias("segment_share_percentage"),
                    "churned_accounts",
                    pct(F.col("churned_accounts"), F.col("accounts")).alias("churn_rate_percentage"),
                    round_div(F.col("life_sum"), F.col("life_n")).alias("avg_lifetime_months"))
            .orderBy(order))
