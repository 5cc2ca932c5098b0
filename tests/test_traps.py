"""Hand-made cases with worked answers (FIXTURES.md section 4).  The last
usage date is 2024-12-31 unless stated."""

import datetime as dt
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from cohortlens.operators import accounts as acc
from cohortlens.operators import activation as act
from cohortlens.operators import activity, churn, growth, quality, retention as ret
from cohortlens.operators import usage_segments as seg
from cohortlens.sources import schema as S
from conftest import d, make_tables, rows

LAST = {"subscription_id": 999, "usage_date": "2024-12-31", "feature_name": "f", "usage_count": 1}
DUMMY_SUB = {"subscription_id": 999, "account_id": 999, "start_date": "2024-01-01"}


def test_t1_blanks_and_ingest(spark):
    raw = spark.createDataFrame([("1", "7", "2024-01-01", ""), ("2", "7", "2024-01-01", None),
                                 ("3", "7", "2024-01-01", "2024-03-01")],
                                "subscription_id string, account_id string, start_date string, end_date string")
    for c in ("plan_tier", "mrr_amount", "upgrade_flag", "downgrade_flag"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="lacks seats, arr_amount"):
        quality.null_audit(raw)
    full = raw
    for c in ("seats", "arr_amount", "is_trial", "churn_flag", "billing_frequency", "auto_renew_flag"):
        full = full.withColumn(c, F.lit(" "))
    audit = quality.null_audit(full).collect()[0]
    assert audit["end_date_nulls"] == 1 and audit["end_date_blanks"] == 1
    assert audit["seats_nulls"] == 0 and audit["billing_frequency_blanks"] == 3
    typed = S.ingest(raw, "subscriptions")
    assert [r.end_date for r in typed.orderBy("subscription_id").collect()] == [None, None, d("2024-03-01")]
    assert dict(typed.dtypes)["start_date"] == "date" and dict(typed.dtypes)["subscription_id"] == "string"


def _t2_tables(spark, start, end, churn_date):
    return make_tables(
        spark,
        accounts=[{"account_id": 1, "signup_date": "2024-01-01"}],
        subscriptions=[{"subscription_id": 10, "account_id": 1, "start_date": start, "end_date": end,
                        "mrr_amount": 100}, DUMMY_SUB],
        usage=[LAST],
        churn=[{"churn_event_id": 1, "account_id": 1, "churn_date": churn_date}])


@pytest.mark.parametrize("start,end,churn_date,exp_end,exp_months", [
    ("2024-05-31", None, "2024-02-10", "2024-12-31", 7),
    ("2024-01-15", "2024-03-15", "2024-06-01", "2024-03-15", 2),
    ("2024-01-15", "2024-09-01", "2024-06-15", "2024-06-15", 5),
])
def test_t2_subscription_end(spark, start, end, churn_date, exp_end, exp_months):
    t = _t2_tables(spark, start, end, churn_date)
    out = acc.subscription_duration(t).where("subscription_id = 10").collect()[0]
    assert out.duration_sub_months == exp_months
    ends = acc.subscription_end(t).where("subscription_id = 10").collect()[0]
    assert ends.end_date_sub == d(exp_end)


def test_t2_post_churn_revenue_and_exclude(spark):
    t = _t2_tables(spark, "2024-05-31", None, "2024-02-10")
    rev = dict(rows(acc.revenue_until_churn(t)))
    assert rev[1] == 700
    rev_ex = dict(rows(acc.revenue_until_churn(t, post_churn="exclude")))
    assert rev_ex[1] == 0


def test_month_arithmetic_in_lifetime(spark):
    t = make_tables(spark,
                    accounts=[{"account_id": 1, "signup_date": "2024-01-31"},
                              {"account_id": 2, "signup_date": "2024-01-31"},
                              {"account_id": 3, "signup_date": "2024-05-01"}],
                    usage=[LAST],
                    churn=[{"churn_event_id": 1, "account_id": 1, "churn_date": "2024-02-29"},
                           {"churn_event_id": 2, "account_id": 2, "churn_date": "2024-03-01"},
                           {"churn_event_id": 3, "account_id": 3, "churn_date": "2024-03-01"}])
    assert dict(rows(acc.account_lifetime(t))) == {1: 0, 2: 1, 3: 0}


def test_t3_orphan_usage(spark):
    t = make_tables(spark,
                    accounts=[{"account_id": 1, "signup_date": "2024-01-01"}],
                    subscriptions=[{"subscription_id": 10, "account_id": 1, "start_date": "2024-01-01"}],
                    usage=[{"subscription_id": 10, "usage_date": "2024-12-31", "feature_name": "a",
                            "usage_count": 5},
                           {"subscription_id": 77, "usage_date": "2024-06-01", "feature_name": "b",
                            "usage_count": 3}])
    fm = {r.account_id: r.total_usage_count for r in acc.feature_metrics(t).collect()}
    assert fm == {1: 5, None: 3}
    summary = acc.accounts_summary(t).collect()
    assert [(r.account_id, r.total_usage_count) for r in summary] == [(1, 5)]


def test_t4_tie_and_null_date(spark):
    t = make_tables(spark,
                    accounts=[{"account_id": 1}, {"account_id": 2}],
                    usage=[LAST],
                    churn=[{"churn_event_id": 8, "account_id": 1, "churn_date": "2024-03-01",
                            "reason_code": "later-id", "refund_amount_usd": 5},
                           {"churn_event_id": 3, "account_id": 1, "churn_date": "2024-03-01",
                            "reason_code": "smaller-id", "refund_amount_usd": 7},
                           {"churn_event_id": 1, "account_id": 2, "churn_date": None,
                            "reason_code": "null-date"},
                           {"churn_event_id": 2, "account_id": 2, "churn_date": "2024-03-01",
                            "reason_code": "dated"}])
    got = {r.account_id: (r.first_churn_date, r.reason_code, r.first_refund_usd, r.total_refund_usd)
           for r in acc.churn_metrics(t).collect()}
    assert got[1] == (d("2024-03-01"), "smaller-id", 7, 12)
    assert got[2][:2] == (d("2024-03-01"), "dated")
    summary = {r.account_id: (r.churn_flag, r.reason_code) for r in acc.accounts_summary(t).collect()}
    assert summary == {1: (1, "smaller-id"), 2: (1, "dated")}


def test_t5_account_without_subscription(spark):
    t = make_tables(spark, accounts=[{"account_id": 1, "signup_date": "2024-01-01"}],
                    subscriptions=[DUMMY_SUB], usage=[LAST])
    r = acc.accounts_summary(t).collect()[0]
    assert (r.subscriptions, r.approx_revenue_till_churn, r.lifetime_months_till_churn) == (0, 0, 0)
    # the stand-alone lifetime (J03) still runs to the last usage date
    assert dict(rows(acc.account_lifetime(t)))[1] == 11
    out = acc.account_outcomes(t).collect()[0]
    assert out.lifetime_months_till_churn == 0


def _mau(spark, churn_rows, usage_dates, signup="2024-01-01"):
    t = make_tables(spark,
                    accounts=[{"account_id": 1, "signup_date": signup}],
                    subscriptions=[{"subscription_id": 10, "account_id": 1, "start_date": "2024-01-01"}],
                    usage=[{"subscription_id": 10, "usage_date": u, "usage_count": 1} for u in usage_dates],
                    churn=churn_rows)
    return {r.active_month for r in activity.monthly_active_users(t).collect()}


def test_t6_mau_churn_bounds(spark):
    two = [{"churn_event_id": 1, "account_id": 1, "churn_date": "2024-02-10"},
           {"churn_event_id": 2, "account_id": 1, "churn_date": "2024-06-10"}]
    assert _mau(spark, two, ["2024-03-15", "2024-07-15"]) == {d("2024-03-01")}
    with_null = [{"churn_event_id": 1, "account_id": 1, "churn_date": None},
                 {"churn_event_id": 2, "account_id": 1, "churn_date": "2024-02-10"}]
    assert _mau(spark, with_null, ["2024-07-15"]) == {d("2024-07-01")}
    assert _mau(spark, [], ["2024-03-05"], signup="2024-03-10") == set()


def test_t6_early_use_counts_in_activity_retention(spark):
    t = make_tables(spark,
                    accounts=[{"account_id": 1, "signup_date": "2024-03-10"}],
                    subscriptions=[{"subscription_id": 10, "account_id": 1, "start_date": "2024-03-10"}],
                    usage=[{"subscription_id": 10, "usage_date": "2024-03-05", "usage_count": 1}])
    assert rows(ret.retention_activity(t), "month_number", "active_accounts") == [(0, 1)]


def test_t7_streaks(spark):
    t = make_tables(spark,
                    accounts=[{"account_id": 1, "signup_date": "2024-01-05"},
                              {"account_id": 2, "signup_date": "2024-01-20"}],
                    subscriptions=[{"subscription_id": 10, "account_id": 1},
                                   {"subscription_id": 20, "account_id": 2}],
                    usage=[{"subscription_id": 10, "usage_date": u} for u in
                           ("2024-01-07", "2024-02-01", "2024-04-01")] +
                          [{"subscription_id": 20, "usage_date": u} for u in ("2024-02-03", "2024-03-03")])
    out = rows(ret.retention_activity(t), "month_number", "active_accounts", "cohort_size",
               "product_retention_rate_percentage")
    assert out == [(0, 1, 2, 50.0), (1, 1, 2, 50.0)]


def test_malformed_values_become_null_and_are_counted(spark):
    raw = spark.createDataFrame([("1", "7", "not-a-date", "12,5", "maybe"), ("2", "7", "2024-01-05", "12.5", "yes"),
                                 ("3", "7", " ", "", None)],
                                "subscription_id string, account_id string, start_date string, mrr_amount string, "
                                "upgrade_flag string")
    for c in ("end_date", "plan_tier", "downgrade_flag"):
        raw = raw.withColumn(c, F.lit("" if c != "plan_tier" else "Pro"))
    got = S.ingest(raw, "subscriptions").orderBy("subscription_id").collect()
    assert [r.start_date for r in got] == [None, d("2024-01-05"), None]
    assert [r.mrr_amount for r in got] == [None, Decimal("12.50"), None]
    assert [r.upgrade_flag for r in got] == [None, True, None]
    bad = S.rejects(raw, "subscriptions").first()
    assert (bad.start_date, bad.mrr_amount, bad.upgrade_flag, bad.end_date, bad.plan_tier) == (1, 1, 1, 0, 0)
    with pytest.raises(ValueError, match="subscriptions: missing columns end_date"):
        S.ingest(raw.drop("end_date").withColumn("end_dat", F.lit("")), "subscriptions")


def test_t8_churn_relative_to_signup_month(spark):
    t = make_tables(spark,
                    accounts=[{"account_id": 1, "signup_date": "2024-03-10"},
                              {"account_id": 2, "signup_date": "2024-03-15"}],
                    usage=[LAST],
                    churn=[{"churn_event_id": 1, "account_id": 1, "churn_date": "2024-02-20"},
                           {"churn_event_id": 2, "account_id": 2, "churn_date": "2024-03-20"}])
    out = rows(ret.retention_payment_first(t), "month_number", "active_accounts", "cohort_size")
    assert out == [(0, 1, 2)]


def _segments_for(spark, usage_rows, lower_bound=None):
    t = make_tables(spark,
                    accounts=[{"account_id": 1, "signup_date": "2024-03-10"}],
                    subscriptions=[{"subscription_id": 10, "account_id": 1, "start_date": "2024-03-10"}],
                    usage=usage_rows)
    out = seg.usage_segments(t, acc.account_outcomes(t), lower_bound=lower_bound)
    return [r.usage_segment for r in out.collect()]


def test_t9_window_has_no_lower_bound(spark):
    early = [{"subscription_id": 10, "usage_date": "2023-12-01", "usage_count": 400}]
    assert _segments_for(spark, early) == ["medium usage"]
    assert _segments_for(spark, early, lower_bound="signup") == ["no_usage"]


def test_t9_day_60_is_inside(spark):
    signup = dt.date(2024, 3, 10)
    day60 = [{"subscription_id": 10, "usage_date": signup + dt.timedelta(days=60), "usage_count": 250}]
    day61 = [{"subscription_id": 10, "usage_date": signup + dt.timedelta(days=61), "usage_count": 250}]
    assert _segments_for(spark, day60) == ["low usage"]
    assert _segments_for(spark, day61) == ["no_usage"]


def test_t10_mom_half_up(spark):
    subs = [{"subscription_id": i, "account_id": i, "start_date": "2024-01-05"} for i in range(800)]
    subs += [{"subscription_id": 1000 + i, "account_id": 1000 + i, "start_date": "2024-02-05"}
             for i in range(799)]
    t = make_tables(spark, subscriptions=subs)
    out = rows(growth.customer_growth(t.subscriptions), "new_customers", "mom_growth_percentage")
    assert out == [(800, None), (799, -0.13)]


def test_t12_empty_input_gives_null_rates(spark):
    t = make_tables(spark)
    assert rows(churn.churn_rate(acc.account_outcomes(t))) == [(0, None)]
    funnel = rows(act.activation_funnel(act.activation_base(t)), "conversion")
    assert funnel == [(None,), (None,), (None,)]


def test_t13_gap_month(spark):
    subs = [{"subscription_id": i, "account_id": i, "start_date": "2024-01-10"} for i in range(2)]
    subs += [{"subscription_id": 10 + i, "account_id": 10 + i, "start_date": "2024-03-10"} for i in range(3)]
    t = make_tables(spark, subscriptions=subs)
    g = growth.mom_trend(growth.customer_growth(t.subscriptions))
    assert rows(g, "month", "new_customers", "running_total_new_customers", "mom_growth_percentage",
                "trend") == [(d("2024-01-01"), 2, 2, None, "positive"),
                             (d("2024-03-01"), 3, 5, 50.0, "positive")]


def test_t15_null_first_in_descending_order(spark):
    t = make_tables(spark, tickets=[{"ticket_id": 1, "account_id": 1, "resolution_time_hours": 5.0},
                                    {"ticket_id": 2, "account_id": 2, "resolution_time_hours": None},
                                    {"ticket_id": 3, "account_id": 3, "resolution_time_hours": 9.0}])
    assert [r.account_id for r in acc.support_metrics(t).collect()] == [2, 3, 1]


def test_median_even_count(spark):
    t = make_tables(spark,
                    accounts=[{"account_id": 1, "signup_date": "2024-01-01"},
                              {"account_id": 2, "signup_date": "2024-01-01"}],
                    subscriptions=[{"subscription_id": 1, "account_id": 1, "start_date": "2024-01-02"},
                                   {"subscription_id": 2, "account_id": 2, "start_date": "2024-01-05"}])
    r = act.activation_median(act.activation_base(t)).collect()[0]
    assert r.median_subscription_from_signup_time_days == 2.5
    assert r.median_usage_from_signup_time_days is None


def test_raw_csv_tables_are_typed_on_ingest(spark, tmp_path):
    from cohortlens.sources.tables import load_raw_tables
    files = {
        "accounts": "account_id,industry,country,signup_date,referral_source,plan_tier,seats\n"
                    "A-1,DevTools,UK,2024-01-10,partner,Pro,5\n",
        "subscriptions": "subscription_id,account_id,start_date,end_date,plan_tier,seats,mrr_amount,"
                         "arr_amount,is_trial,upgrade_flag,downgrade_flag,churn_flag,billing_frequency,"
                         "auto_renew_flag\n"
                         "S-10,A-1,2024-01-15,,Pro,5,99.50,1194,False,True,False,False,monthly,True\n",
        "feature_usage": "usage_id,subscription_id,usage_date,feature_name,usage_count,usage_duration_secs,"
                         "error_count,is_beta_feature\n"
                         "U-1,S-10,2024-02-01,reports,7,30,1,False\n",
        "support_tickets": "ticket_id,account_id,submitted_at,resolution_time_hours,satisfaction_score,"
                           "escalation_flag\nT-1,A-1,2024-02-02,3.5,,True\n",
        "churn_events": "churn_event_id,account_id,churn_date,reason_code,refund_amount_usd\n"
                        "C-7,A-1,2024-03-05,pricing,0\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    t = load_raw_tables(spark, str(tmp_path))
    sub = t.subscriptions.collect()[0]
    assert sub.end_date is None and sub.upgrade_flag is True and sub.start_date == d("2024-01-15")
    assert sub.account_id == "A-1" and "billing_frequency" in t.subscriptions.columns
    audit = quality.null_audit(t.subscriptions).collect()[0]
    assert audit["end_date_nulls"] == 1 and audit["arr_amount_nulls"] == 0
    s = acc.accounts_summary(t).collect()[0]
    assert (s.account_id, s.subscriptions, s.total_usage_count, s.support_tickets, s.churn_flag) == \
        ("A-1", 1, 7, 1, 1)
    assert s.avg_satisfaction_score is None and s.lifetime_months_till_churn == 1
    # money keeps its cents: 99.50 a month from 2024-01-15 to the churn on 2024-03-05
    assert s.approx_revenue_till_churn == Decimal("99.50") and s.first_refund_usd == 0
    summary = acc.revenue_lifetime_summary(t).collect()[0]
    assert summary.avg_approx_revenue_till_churn == 99.5
    assert [r.mau for r in activity.monthly_active_users(t).collect()] == [1]


def test_retention_matrix_rejects_duplicate_cells(spark):
    long = spark.createDataFrame(
        [(d("2024-01-01"), 0, 100.0), (d("2024-01-01"), 1, 50.0), (d("2024-02-01"), 0, 100.0)],
        "cohort_month date, month_number long, r double")
    m = ret.retention_matrix(long, "r", months=[0, 1]).collect()
    assert [(x.cohort_m_short, x["0"], x["1"]) for x in m] == [("2024-01", 100.0, 50.0), ("2024-02", 100.0, None)]
    dup = long.unionByName(long.limit(1))
    with pytest.raises(Exception, match="duplicate"):
        ret.retention_matrix(dup, "r", months=[0, 1]).collect()
    with pytest.raises(Exception, match="has no column"):
        ret.retention_matrix(long, "r", months=[0]).collect()
    assert len(ret.retention_matrix(long, "r").columns) == 1 + len(ret.MATRIX_MONTHS)
