"""Per-account metrics (J03-J12) and the building blocks other jobs share.

Partitioning: every output here is keyed by ``account_id`` and every step is a
group-by or equi-join on ``account_id`` (or ``subscription_id``), so the
five-way join of ``accounts_summary`` is co-partitioned: each side arrives
hash-partitioned on ``account_id`` from its own aggregation and the joins add
no further exchange.  Nothing account-sized is broadcast - at scale accounts
are billions of rows; the one-row "last usage date" is a scalar subquery,
evaluated once and inlined as a literal (no cross join).

Skew: a hot account or subscription is absorbed by partial (map-side)
aggregation before any exchange; the first churn event per account is a
``min_by`` aggregate (partially aggregatable), not a window sort of all of
the account's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions import age_months, round_div, round_float_as_numeric
from cohortlens.operators.skew import lookup_join
from cohortlens.sources.tables import Tables

POST_CHURN_MODES = ("to_max_date", "exclude")


def _flag(c: str) -> Column:
    """``CASE WHEN c THEN 1 ELSE 0 END`` (NULL counts as 0)."""
    return F.when(F.col(c), F.lit(1)).otherwise(F.lit(0))


def max_usage_date(feature_usage: DataFrame) -> Column:
    """Last usage date in the data, as a scalar subquery column."""
    return feature_usage.agg(F.max("usage_date")).scalar()


def last_use(t: Tables) -> Column:
    return max_usage_date(t.pick("feature_usage", "usage_date"))


def first_churn(t: Tables) -> DataFrame:
    """account_id, first_churn_date (earliest non-NULL churn date) and a
    ``churned`` marker that is 1 for every account with an event, even when
    all its dates are NULL."""
    return t.pick("churn_events", "account_id", "churn_date").groupBy("account_id").agg(
        F.expr("min(churn_date) as first_churn_date"), F.expr("max(1) as churned"))


def account_lifetime(t: Tables, max_date: Column | None = None) -> DataFrame:
    """Whole months from signup to first churn, or to the last usage
    date for accounts that never churned; never below 0."""
    max_date = last_use(t) if max_date is None else max_date
    end = F.coalesce(F.col("first_churn_date"), max_date)
    return (t.pick("accounts", "account_id", "signup_date")
            .join(first_churn(t), "account_id", "left")
            .select("account_id",
                    F.greatest(age_months(F.col("signup_date"), end), F.lit(0))
                    .cast("long").alias("lifetime_months_till_churn")))


def subscription_end(t: Tables, post_churn: str = "to_max_date",
                     max_date: Column | None = None) -> DataFrame:
    """Effective end of each subscription for revenue "until churn".

    * an own end date before the first churn (or with no churn) is kept;
    * otherwise a subscription that started on/before the first churn ends
      at the first churn;
    * anything else runs to the last usage date.  That includes a
      subscription that starts *after* the first churn (the source counts its
      revenue to the end of the data); ``post_churn='exclude'`` gives such a
      subscription zero length instead.
    """
    max_date = last_use(t) if max_date is None else max_date
    fc = first_churn(t).select("account_id", "first_churn_date")
    return _subscription_end_with(t, fc, post_churn, max_date)


def _subscription_end_with(t: Tables, fc_df: DataFrame, post_churn: str, max_date: Column,
                           mark_horizon: bool = False) -> DataFrame:
    if post_churn not in POST_CHURN_MODES:
        raise ValueError(f"post_churn must be one of {POST_CHURN_MODES}")
    fc, start, end = F.col("first_churn_date"), F.col("start_date"), F.col("end_date")
    fallback = max_date
    if post_churn == "exclude":
        fallback = F.when(fc.isNotNull() & (start > fc), start).otherwise(max_date)
    own_end, at_churn = end.isNotNull() & (fc.isNull() | (end < fc)), fc.isNotNull() & (start <= fc)
    end_sub = F.when(own_end, end).when(at_churn, fc).otherwise(fallback)
    marks = [F.when(own_end | at_churn, False).otherwise(True).alias("to_horizon")] if mark_horizon else []
    subs = t.pick("subscriptions", "subscription_id", "account_id", "start_date", "end_date",
                  "mrr_amount", "upgrade_flag", "downgrade_flag")
    return (lookup_join(subs, fc_df, "account_id", "left", hot=t.hot_accounts)
            .select("subscription_id", "account_id",
                    start.alias("start_date_sub"), end_sub.alias("end_date_sub"),
                    "mrr_amount", "upgrade_flag", "downgrade_flag", *marks))


def subscription_duration(t: Tables, post_churn: str = "to_max_date",
                          max_date: Column | None = None) -> DataFrame:
    """Whole months of each subscription up to its effective end."""
    ends = subscription_end(t, post_churn, max_date)
    months = F.greatest(age_months(F.col("start_date_sub"), F.col("end_date_sub")), F.lit(0))
    return ends.select("subscription_id", "account_id",
                       months.cast("long").alias("duration_sub_months"),
                       "mrr_amount", "upgrade_flag", "downgrade_flag")


def _revenue() -> Column:
    return F.sum(F.col("mrr_amount") * F.col("duration_sub_months"))


def revenue_until_churn(t: Tables, post_churn: str = "to_max_date") -> DataFrame:
    """Approximate revenue per account: sum of MRR x months."""
    return (subscription_duration(t, post_churn).groupBy("account_id")
            .agg(_revenue().alias("approx_revenue_till_churn")))


def revenue_lifetime_summary(t: Tables, post_churn: str = "to_max_date") -> DataFrame:
    """Min / max / mean (2 decimals) of revenue and of lifetime over the
    accounts that have both.  One global aggregate: partial per task, one
    row per task to the final step."""
    max_date = last_use(t)
    rev = subscription_duration(t, post_churn, max_date).groupBy("account_id") \
        .agg(_revenue().alias("r"))
    life = account_lifetime(t, max_date).withColumnRenamed("lifetime_months_till_churn", "l")
    r, l = F.col("r"), F.col("l")
    return (rev.join(life, "account_id")
            .agg(F.min(r).alias("min_aprox_revenue_till_churn"),
                 F.max(r).alias("max_approx_revenue_till_churn"),
                 round_div(F.sum(r), F.count(r), num_scale=2).alias("avg_approx_revenue_till_churn"),
                 F.min(l).alias("min_lifetime_till_churn"),
                 F.max(l).alias("max_lifetime_till_churn"),
                 round_div(F.sum(l), F.count(l)).alias("avg_lifetime_till_churn")))


def subscription_metrics(t: Tables, post_churn: str = "to_max_date") -> DataFrame:
    """Subscriptions, revenue until churn, lifetime and up/downgrade
    flags per account that has subscriptions."""
    max_date = last_use(t)
    per_account = (subscription_duration(t, post_churn, max_date).groupBy("account_id")
                   .agg(F.count(F.lit(1)).alias("subscriptions"),
                        _revenue().alias("approx_revenue_till_churn"),
                        F.max(_flag("upgrade_flag")).alias("had_upgrade"),
                        F.max(_flag("downgrade_flag")).alias("had_downgrade")))
    return (per_account.join(account_lifetime(t, max_date), "account_id", "left")
            .select("account_id", "subscriptions", "approx_revenue_till_churn",
                    "lifetime_months_till_churn", "had_upgrade", "had_downgrade"))


def feature_metrics(t: Tables) -> DataFrame:
    """Distinct features, usage, errors and beta use per account.

    Usage is first reduced to one row per (subscription, feature) - a hot
    subscription collapses map-side - then mapped to accounts.  Usage whose
    subscription is unknown forms a NULL-account row, as in the source."""
    per_sub = (t.feature_usage.groupBy("subscription_id", "feature_name")
               .agg(F.sum("usage_count").alias("u"), F.sum("error_count").alias("e"),
                    F.max(_flag("is_beta_feature")).alias("b")))
    per_feature = (per_sub
                   .join(t.pick("subscriptions", "subscription_id", "account_id"),
                         "subscription_id", "left")
                   .groupBy("account_id", "feature_name")
                   .agg(F.sum("u").alias("u"), F.sum("e").alias("e"), F.max("b").alias("b")))
    return (per_feature.groupBy("account_id")
            .agg(F.count("feature_name").alias("unique_features_used"),
                 F.sum("u").alias("total_usage_count"),
                 F.sum("e").alias("sum_errors"),
                 F.max("b").alias("used_beta_feature")))


def support_metrics(t: Tables, ordered: bool = True) -> DataFrame:
    """Tickets, mean resolution time and satisfaction, escalations per
    account; ordered by mean resolution time descending, NULL first."""
    out = (t.support_tickets.groupBy("account_id")
           .agg(F.count(F.lit(1)).alias("support_tickets"),
                F.avg("resolution_time_hours").alias("avg_resolution_time"),
                F.avg("satisfaction_score").alias("avg_satisfaction_score"),
                F.sum(_flag("escalation_flag")).cast("long").alias("escalations")))
    return out.orderBy(F.col("avg_resolution_time").desc_nulls_first()) if ordered else out


def churn_metrics(t: Tables, tie_breaker: str = "churn_event_id", ordered: bool = True) -> DataFrame:
    """First churn event (date, reason, refund) and total refund per
    account with at least one churn event.

    "First" is the earliest date, NULL dates last, ties broken by the
    smaller ``tie_breaker`` - a deterministic order the source leaves open.
    ``min_by`` keeps this a partially aggregatable group-by."""
    d = F.col("churn_date")
    first = F.min_by(F.struct(d.alias("d"), F.col("reason_code").alias("r"),
                              F.col("refund_amount_usd").alias("f")),
                     F.struct(d.isNull(), d, F.col(tie_breaker)))
    out = (t.churn_events.groupBy("account_id")
           .agg(first.alias("first"), F.sum("refund_amount_usd").alias("total_refund_usd"))
           .select("account_id", F.lit(1).alias("churn_flag"),
                   F.col("first.d").alias("first_churn_date"),
                   F.col("first.r").alias("reason_code"),
                   F.col("first.f").alias("first_refund_usd"),
                   "total_refund_usd"))
    return out.orderBy(F.col("account_id").asc_nulls_last()) if ordered else out


# The summary's columns, in output order.
SUMMARY_COLUMNS = [
    "account_id", "industry", "country", "signup_date", "referral_source",
    "initial_plan_tier", "seats", "subscriptions", "approx_revenue_till_churn",
    "lifetime_months_till_churn", "had_upgrade", "had_downgrade",
    "unique_features_used", "total_usage_count", "sum_errors", "used_beta_feature",
    "support_tickets", "avg_resolution_time", "avg_satisfaction_score", "escalations",
    "churn_flag", "first_churn_date", "reason_code", "first_refund_usd", "total_refund_usd",
]


def _churn_per_account(t: Tables, tie_breaker: str = "churn_event_id") -> DataFrame:
    """One aggregate of churn events per account serving the whole summary:
    first churn date (for lifetimes and subscription ends) and the first
    event's details (J11).  It is used twice in one plan.  The filter, true
    for every account with an event, reads all its columns, so pruning leaves
    both uses alike and they share one exchange."""
    d = F.col("churn_date")
    first = F.min_by(F.struct(F.col("reason_code").alias("r"), F.col("refund_amount_usd").alias("f")),
                     F.struct(d.isNull(), d, F.col(tie_breaker)))
    return (t.churn_events.groupBy("account_id")
            .agg(F.min(d).alias("first_churn_date"), first.alias("first"),
                 F.sum("refund_amount_usd").alias("total_refund_usd"))
            .where(F.col("first").isNotNull() | F.col("total_refund_usd").isNotNull()
                   | F.col("first_churn_date").isNotNull()))


def accounts_summary(t: Tables, post_churn: str = "to_max_date", max_date: Column | None = None,
                     open_ended: bool = False) -> DataFrame:
    """One row per account, 25 columns; with ``open_ended`` one more: does
    a value depend on the last usage date (no churn date, or a subscription that
    has no own end and starts after the first churn or without one)?

    Four left joins on account_id of per-account aggregates, all
    hash-partitioned on account_id, so the joins add no exchange.  The churn
    aggregate is shared by the subscription ends, the lifetime and the churn
    columns.  Lifetime is computed from the account row and reaches the
    summary only for accounts with subscriptions (0 otherwise), as in the
    source.  The first churn *date* of J11 equals the earliest non-NULL churn
    date, which is the date lifetimes use."""
    max_date = last_use(t) if max_date is None else max_date
    churn = _churn_per_account(t)
    ends = _subscription_end_with(t, churn.select("account_id", "first_churn_date"),
                                  post_churn, max_date, open_ended)
    months = F.greatest(age_months(F.col("start_date_sub"), F.col("end_date_sub")), F.lit(0))
    subs = (ends.withColumn("duration_sub_months", months).groupBy("account_id")
            .agg(F.count(F.lit(1)).alias("subscriptions"), _revenue().alias("approx_revenue_till_churn"),
                 F.max(_flag("upgrade_flag")).alias("had_upgrade"),
                 F.max(_flag("downgrade_flag")).alias("had_downgrade"),
                 *([F.bool_or("to_horizon").alias("to_horizon")] if open_ended else [])))
    acc = t.pick("accounts", "account_id", "industry", "country", "signup_date", "referral_source", "plan_tier",
                 "seats").withColumnRenamed("plan_tier", "initial_plan_tier")
    joined = (acc
              .join(subs, "account_id", "left")
              .join(feature_metrics(t), "account_id", "left")
              .join(support_metrics(t, ordered=False), "account_id", "left")
              .join(churn, "account_id", "left"))
    life = F.greatest(age_months(F.col("signup_date"),
                                 F.coalesce(F.col("first_churn_date"), max_date)), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    churned = F.col("first").isNotNull()
    return joined.select(
        "account_id", "industry", "country", "signup_date", "referral_source",
        "initial_plan_tier", "seats",
        zero("subscriptions"), zero("approx_revenue_till_churn"),
        F.when(F.col("subscriptions").isNotNull(), life).otherwise(F.lit(0)).cast("long")
        .alias("lifetime_months_till_churn"),
        zero("had_upgrade"), zero("had_downgrade"),
        zero("unique_features_used"), zero("total_usage_count"), zero("sum_errors"),
        zero("used_beta_feature"), zero("support_tickets"),
        round_float_as_numeric(F.col("avg_resolution_time")).alias("avg_resolution_time"),
        round_float_as_numeric(F.col("avg_satisfaction_score")).alias("avg_satisfaction_score"),
        zero("escalations"),
        F.when(churned, F.lit(1)).otherwise(F.lit(0)).alias("churn_flag"),
        F.when(churned, F.col("first_churn_date")).alias("first_churn_date"),
        F.col("first.r").alias("reason_code"),
        F.coalesce(F.col("first.f"), F.lit(0).cast("long")).alias("first_refund_usd"),
        zero("total_refund_usd"),
        *([(F.col("first_churn_date").isNull() | F.coalesce(F.col("to_horizon"), F.lit(False))).alias("open_ended")]
          if open_ended else []))


#: Columns of ``account_outcomes``.
OUTCOME_COLUMNS = ("account_id", "industry", "country", "signup_date", "referral_source", "initial_plan_tier",
                   "churn_flag", "first_churn_date", "lifetime_months_till_churn")
_OF_CHURN = ("churn_flag", "first_churn_date", "lifetime_months_till_churn")


def account_outcomes(t: Tables, columns=OUTCOME_COLUMNS) -> DataFrame:
    """The summary columns the segment jobs read - dimensions, churn_flag and
    lifetime_months_till_churn - without the feature, ticket and revenue
    aggregates they would never use.  Same values as ``accounts_summary``.

    A join with one row per account changes no other column but can't be
    dropped by the optimiser, which doesn't know that; so only the joins that
    the asked ``columns`` need are made."""
    lifetime = "lifetime_months_till_churn" in columns
    given = {"initial_plan_tier": "plan_tier"}
    dims = [c for c in columns if c not in _OF_CHURN]
    reads = dict.fromkeys(["account_id", *[given.get(c, c) for c in dims], *(["signup_date"] if lifetime else [])])
    df = t.pick("accounts", *reads)
    if any(c in columns for c in _OF_CHURN):
        df = df.join(first_churn(t), "account_id", "left")
    out = {c: F.col(given.get(c, c)).alias(c) for c in dims}
    out["churn_flag"] = F.expr("coalesce(churned, 0) as churn_flag")
    out["first_churn_date"] = F.col("first_churn_date")
    if lifetime:
        has_sub = t.pick("subscriptions", "account_id").groupBy("account_id").agg(F.expr("max(1) as has_sub"))
        df = df.join(has_sub, "account_id", "left")
        life = F.greatest(age_months(F.col("signup_date"), F.coalesce(F.col("first_churn_date"), last_use(t))), F.lit(0))
        out["lifetime_months_till_churn"] = (F.when(F.col("has_sub").isNotNull(), life).otherwise(F.lit(0))
                                             .cast("long").alias("lifetime_months_till_churn"))
    return df.select(*[out[c] for c in columns])
