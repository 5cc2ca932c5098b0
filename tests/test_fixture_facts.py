"""The facts FIXTURES.md section 3 measured on the driver tables at sf0.01,
recomputed by our jobs."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import accounts as acc
from cohortlens.operators import activation as act
from cohortlens.operators import activity, growth, retention as ret
from cohortlens.operators import usage_segments as seg
from cohortlens.sources.tables import load_driver_tables
from conftest import SF_ORACLE


@pytest.fixture(scope="module")
def t(spark):
    return load_driver_tables(spark, SF_ORACLE)


def test_table_sizes(t):
    assert (t.accounts.count(), t.subscriptions.count(), t.feature_usage.count()) == (1500, 15000, 60000)
    assert t.churn_events.count() == 1000
    assert t.churn_events.select("account_id").distinct().count() == 722
    assert t.support_tickets.count() == 2014
    assert t.support_tickets.select("account_id").distinct().count() == 150


def test_first_use_before_signup(t):
    q = act.usage_quality(act.activation_base(t)).collect()[0]
    assert q.invalid_usage_data == 1104 and q.total_count == 1500


def test_subscriptions_starting_after_first_churn(t):
    fc = acc.first_churn(t)
    n = (t.subscriptions.join(fc, "account_id")
         .where(F.col("start_date") > F.col("first_churn_date")).count())
    assert n == 3812


def test_row_counts_of_monthly_jobs(t):
    assert growth.customer_growth(t.subscriptions).count() == 51
    assert activity.monthly_active_users(t).count() == 83
    assert ret.retention_payment_first(t).count() == 2822
    assert ret.retention_activity(t).count() == 115
    signup_months = t.accounts.select(F.trunc("signup_date", "MM")).distinct().count()
    assert signup_months == 51


def test_medians(t):
    m = act.activation_median(act.activation_base(t)).collect()[0]
    assert (m.median_subscription_from_signup_time_days, m.median_usage_from_signup_time_days) == (14.5, 43.5)


@pytest.mark.parametrize("limits,expected", [
    ((300, 700), {"no_usage": 159, "low usage": 1266, "medium usage": 73, "high usage": 2}),
    ((50, 150), {"no_usage": 159, "low usage": 393, "medium usage": 572, "high usage": 376}),
])
def test_usage_bands(t, limits, expected):
    out = seg.usage_segments(t, acc.account_outcomes(t), limits=limits).collect()
    assert {r.usage_segment: r.accounts for r in out} == expected


def test_sf01_only_cases(spark):
    """At sf0.1: one account without subscriptions (lifetime 0 in the
    summary) and one account with two churn events on one day (the smaller
    event id is first)."""
    big = load_driver_tables(spark, "/root/testdata/sf0.1")
    summary = acc.accounts_summary(big)
    no_subs = summary.where("subscriptions = 0").collect()
    assert len(no_subs) == 1 and no_subs[0].lifetime_months_till_churn == 0
    ties = (big.churn_events.groupBy("account_id", "churn_date").count().where("count > 1")
            .select("account_id").collect())
    assert len(ties) == 1
    tied = ties[0].account_id
    events = big.churn_events.where(F.col("account_id") == tied).orderBy("churn_date", "churn_event_id").collect()
    first = acc.churn_metrics(big).where(F.col("account_id") == tied).collect()[0]
    assert first.reason_code == events[0].reason_code and first.first_refund_usd == events[0].refund_amount_usd
