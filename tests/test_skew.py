"""A hot key holding a third of all rows: results stay exact, and its join is
spread over as many salts as its size needs."""

import re

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import accounts as acc
from cohortlens.operators import activity, retention as ret
from cohortlens.operators.skew import hot_keys, lookup_join
from cohortlens.sources.tables import load_driver_tables
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def skewed(spark):
    """Driver tables at sf0.001 with every usage row of a third of the
    subscriptions re-pointed at one subscription of one account."""
    t = load_driver_tables(spark, SF_SMALL)
    hot_sub = t.subscriptions.agg(F.min("subscription_id")).collect()[0][0]
    usage = t.feature_usage.withColumn(
        "subscription_id",
        F.when(F.col("subscription_id") % 3 == 0, F.lit(hot_sub)).otherwise(F.col("subscription_id")))
    return t.with_(feature_usage=usage), hot_sub


def _rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def _brute_mau(t):
    """Months and their active accounts, from collected rows with Python sets."""
    owner = dict(_rows(t.subscriptions, "subscription_id", "account_id"))
    signup = dict(_rows(t.accounts, "account_id", "signup_date"))
    left = {}
    for account, day in _rows(t.churn_events, "account_id", "churn_date"):
        left.setdefault(account, []).append(day)
    seen = {}
    for sub, day in _rows(t.feature_usage, "subscription_id", "usage_date"):
        account = owner.get(sub)
        days = left.get(account)
        if account in signup and day >= signup[account] and (not days or None in days or day <= max(days)):
            seen.setdefault(day.replace(day=1), set()).add(account)
    return sorted((m, len(a)) for m, a in seen.items())


def test_hot_subscription_results_exact(skewed):
    t, hot = skewed
    assert t.feature_usage.where(F.col("subscription_id") == hot).count() >= 0.3 * t.feature_usage.count()
    got = sorted(tuple(r) for r in activity.monthly_active_users(t).collect())
    assert got == _brute_mau(t)
    fm = {r.account_id: r.total_usage_count for r in acc.feature_metrics(t).collect()}
    assert sum(v for v in fm.values() if v) == t.feature_usage.agg(F.sum("usage_count")).collect()[0][0]
    assert ret.retention_activity(t).count() > 0


def _brute_activity(t):
    """Cohort cells from collected rows: an account counts in month k while
    every month from its cohort's on has a use."""
    owner = dict(_rows(t.subscriptions, "subscription_id", "account_id"))
    number = lambda d: 12 * d.year + d.month
    used = {}
    for sub, day in _rows(t.feature_usage, "subscription_id", "usage_date"):
        used.setdefault(owner.get(sub), set()).add(number(day))
    sizes, cells = {}, {}
    for account, signup in _rows(t.accounts, "account_id", "signup_date"):
        cohort, k = signup.replace(day=1), 0
        sizes[cohort] = sizes.get(cohort, 0) + 1
        while number(signup) + k in used.get(account, ()):
            cells[cohort, k] = cells.get((cohort, k), 0) + 1
            k += 1
    return sorted((c, k, n, sizes[c]) for (c, k), n in cells.items())


def test_hot_account_results_exact(spark):
    """One account holds a third of all subscriptions (and so of all usage)."""
    t = load_driver_tables(spark, SF_SMALL)
    hot_account = t.accounts.agg(F.min("account_id")).collect()[0][0]
    subs = t.subscriptions.withColumn(
        "account_id",
        F.when(F.col("subscription_id") % 3 == 1, F.lit(hot_account)).otherwise(F.col("account_id")))
    t = t.with_(subscriptions=subs)
    got = sorted((r.cohort_month, r.month_number, r.active_accounts, r.cohort_size)
                 for r in ret.retention_activity(t).collect())
    assert got == _brute_activity(t) and len(got) > 0
    mau = sorted(tuple(r) for r in activity.monthly_active_users(t).collect())
    assert mau == _brute_mau(t)
    # the same through salted joins: the hot account takes many salts
    salted = lookup_join(t.subscriptions, activity.account_activity_bounds(t), "account_id", "inner", rows_per_task=20)
    plain = t.subscriptions.join(activity.account_activity_bounds(t), "account_id")
    assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_lookup_join_hot_path_equals_plain_join(spark):
    t = load_driver_tables(spark, SF_SMALL)
    subs = t.subscriptions.withColumn(
        "account_id", F.when(F.col("subscription_id") % 3 == 1, F.lit(7)).otherwise(F.col("account_id")))
    lookup = t.churn_events.groupBy("account_id").agg(F.min("churn_date").alias("fc"))
    hot = hot_keys(subs, "account_id", rows_per_task=100)
    assert [r.account_id for r in hot.collect()] == [7]          # only the hot account
    assert hot_keys(subs, "account_id", rows_per_task=1).count() <= subs.count()
    subs = subs.unionByName(subs.where("subscription_id < 40").withColumn("account_id", F.lit(None).cast("long")))
    for how in ("left", "inner"):
        got = lookup_join(subs, lookup, "account_id", how, rows_per_task=50)
        want = subs.join(lookup, "account_id", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at scale: only the hints
        try:
            plan = got._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert "BroadcastHashJoin" in plan and "xxhash64" in plan
        # the join is keyed by (key, salt): a hot key is spread over its salts
        assert re.search(r"hashpartitioning\(account_id#\d+L?, _salt#\d+", plan)


def test_salting_spreads_a_hot_key_and_bounds_replication(spark):
    from cohortlens.operators import skew
    t = load_driver_tables(spark, SF_SMALL)
    subs = t.subscriptions.withColumn(
        "account_id", F.when(F.col("subscription_id") % 3 == 1, F.lit(7)).otherwise(F.col("account_id")))
    hot = skew.hot_keys(subs, "account_id", rows_per_task=100).collect()
    assert [(r.account_id, r._rows) for r in hot] == [(7, subs.where("account_id = 7").count())]
    rows_per_task = 40
    salts = -(-hot[0]._rows // rows_per_task)
    joined = skew.lookup_join(subs, t.accounts.select("account_id", "signup_date"), "account_id", "left",
                              rows_per_task=rows_per_task)
    # the hot account's rows are spread over exactly ``salts`` join keys of ~rows_per_task rows
    per_salt = (subs.where("account_id = 7")
                .select(F.pmod(F.xxhash64(*subs.columns), F.lit(salts)).alias("s"))
                .groupBy("s").count().collect())
    assert len(per_salt) == salts and max(r["count"] for r in per_salt) <= 3 * rows_per_task
    assert joined.count() == subs.count()
    assert joined.where("account_id = 7 and signup_date is null").count() == 0


def test_hot_keys_are_counted_once_per_run(spark):
    """Handed-in hot keys give the same result without another count of the large table."""
    from cohortlens.sources.sinks import materialize
    t = load_driver_tables(spark, SF_SMALL)
    subs = t.subscriptions.withColumn(
        "account_id", F.when(F.col("subscription_id") % 3 == 1, F.lit(7)).otherwise(F.col("account_id")))
    hot = materialize(hot_keys(subs, "account_id", rows_per_task=100), "hot")
    lookup = t.churn_events.groupBy("account_id").agg(F.min("churn_date").alias("fc"))
    got = lookup_join(subs, lookup, "account_id", "left", rows_per_task=50, hot=hot)
    want = subs.join(lookup, "account_id", "left").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    given, counted = (x._jdf.queryExecution().optimizedPlan().toString().count("count(1)")
                      for x in (got, lookup_join(subs, lookup, "account_id", "left", rows_per_task=50)))
    assert given == 0 < counted
    kept = t.with_(hot_accounts=hot)
    assert kept.with_(feature_usage=t.feature_usage).hot_accounts is hot
    assert kept.with_(subscriptions=subs).hot_accounts is None
