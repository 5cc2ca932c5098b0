"""Named queries over the driver tables: name -> f(spark, sf_dir) -> DataFrame.

Each query builds a lazy plan from the mapped input tables; nothing runs
until the caller acts on the DataFrame.  Queries that read "accounts summary"
columns use the slim per-account outcomes (the same values) so Catalyst
never computes the feature/ticket/revenue aggregates they would discard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.operators import (
    accounts as acc, activation as act, activity, churn, growth, quality, retention as ret,
    usage_segments as seg,
)
from cohortlens.sources.tables import Tables, load_driver_tables
from cohortlens.streaming import mau as smau

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    return load_driver_tables(spark, sf_dir)


def _outcomes(spark, d, *columns):
    return acc.account_outcomes(_t(spark, d), columns)


def _base(spark, d):
    return act.activation_base(_t(spark, d))


def _growth(spark, d):
    return growth.customer_growth(_t(spark, d).pick("subscriptions", "account_id", "start_date"))


def _segments(spark, d):
    return churn.churn_by_segment(_outcomes(spark, d, *[c for _, c in churn.SEGMENTS], "churn_flag"))


def _mau(spark, d):
    return activity.monthly_active_users(_t(spark, d))


def _mau_stream(spark, d):
    """J15 through the step the streaming job runs on every micro-batch, with
    all usage files as one batch on an empty state: lazy like any query."""
    t = _t(spark, d)
    return smau.monthly_counts(smau.active_pairs(t.feature_usage, t))


def _usage_segments(spark, d):
    t = _t(spark, d)
    return seg.usage_segments(t, acc.account_outcomes(
        t, ("account_id", "signup_date", "churn_flag", "lifetime_months_till_churn")))


def _retention_mean(spark, d):
    return ret.retention_means_of(_t(spark, d))


#: Setting: how many month numbers the matrices have as columns.
MATRIX_SETTING = "spark.cohortlens.matrix.months"


def _matrix(job: Callable[[Tables], DataFrame], rate: str) -> Query:
    def query(spark, d):
        months = int(spark.conf.get(MATRIX_SETTING, str(len(ret.MATRIX_MONTHS))))
        return ret.retention_matrix(job(_t(spark, d)), rate, range(months))
    return query


QUERIES: dict[str, Query] = {
    "key_census": lambda s, d: quality.key_census(_t(s, d).pick("subscriptions", "subscription_id", "account_id")),
    "null_audit": lambda s, d: quality.null_audit(_t(s, d).subscriptions),
    "account_lifetime": lambda s, d: acc.account_lifetime(_t(s, d)),
    "subscription_end": lambda s, d: acc.subscription_end(_t(s, d)),
    "subscription_duration": lambda s, d: acc.subscription_duration(_t(s, d)),
    "revenue_until_churn": lambda s, d: acc.revenue_until_churn(_t(s, d)),
    "revenue_lifetime_summary": lambda s, d: acc.revenue_lifetime_summary(_t(s, d)),
    "subscription_metrics": lambda s, d: acc.subscription_metrics(_t(s, d)),
    "feature_metrics": lambda s, d: acc.feature_metrics(_t(s, d)),
    "support_metrics": lambda s, d: acc.support_metrics(_t(s, d)),
    "churn_metrics": lambda s, d: acc.churn_metrics(_t(s, d)),
    "accounts_summary": lambda s, d: acc.accounts_summary(_t(s, d)),
    "customer_growth": _growth,
    "subscription_growth": lambda s, d: growth.subscription_growth(
        _t(s, d).pick("subscriptions", "subscription_id", "start_date", "plan_tier")),
    "monthly_active_users": _mau,
    "monthly_active_users_stream": _mau_stream,
    "activation_funnel": lambda s, d: act.activation_funnel(_base(s, d)),
    "activation_median": lambda s, d: act.activation_median(_base(s, d)),
    "usage_quality": lambda s, d: act.usage_quality(_base(s, d)),
    "churn_rate": lambda s, d: churn.churn_rate(_outcomes(s, d, "churn_flag")),
    "churn_by_segment": _segments,
    "retention_activity": lambda s, d: ret.retention_activity(_t(s, d)),
    "retention_payment_first": lambda s, d: ret.retention_payment_first(_t(s, d)),
    "retention_payment_last": lambda s, d: ret.retention_payment_last(_t(s, d)),
    "usage_segments": _usage_segments,
    "month_labels": lambda s, d: growth.month_labels(_growth(s, d)),
    "mom_trend": lambda s, d: growth.mom_trend(_growth(s, d)),
    "retention_matrix": _matrix(ret.retention_payment_first, ret.FIRST_CHURN_RATE),
    "retention_matrix_activity": _matrix(ret.retention_activity, ret.ACTIVITY_RATE),
    "retention_matrix_payment_last": _matrix(ret.retention_payment_last, ret.LAST_CHURN_RATE),
    "retention_mean": _retention_mean,
    "country_accounts": lambda s, d: churn.country_accounts(_outcomes(s, d, "account_id", "country")),
    "country_churn": lambda s, d: churn.country_churn(_outcomes(s, d, "country", "churn_flag")),
    "country_lifetime": lambda s, d: churn.country_lifetime(_outcomes(s, d, "country", "lifetime_months_till_churn")),
    "segment_sizes": lambda s, d: churn.segment_sizes(_segments(s, d)),
    "worst_subsegment": lambda s, d: churn.worst_subsegment(_segments(s, d)),
    "usage_quality_split": lambda s, d: act.usage_quality_split(
        act.usage_quality(_base(s, d))),
    "mau_summary": lambda s, d: activity.mau_summary(
        activity.monthly_active_users(_t(s, d), ordered=False)),
    "country_share": lambda s, d: churn.country_share(_outcomes(s, d, "account_id", "country")),
}

FLAGSHIP = "retention_payment_first"
