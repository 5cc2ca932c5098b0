"""Cohort retention (J21-J23), the retention matrix (J27) and mean retention
at given months (J28).

Activity retention (J21) counts an account in month k of its signup cohort
only while it was active in *every* month 0..k (an unbroken streak; no
activity in the signup month means it is never counted).  Use before the
signup within the signup month counts, use after churn is not removed.

Payment retention (J22, J23) counts an account in every month from its
signup month to the month of its first (J22) or last (J23) churn, or of the
last usage date when it never churned.  An account whose churn month lies
before its signup month is in its cohort's size but in no month.

Scale: payment retention never expands accounts into account-months.  Each
account is one tenure T (months from cohort to last month); the counts per
(cohort, T) - a partially aggregated group-by over accounts, whose output is
bounded by the calendar - are turned into "accounts with tenure >= k" by a
reverse running sum per cohort, and each histogram row emits only the month
numbers between the previous tenure and its own: work proportional to the
result, one pass over accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions import age_months, month_of, pct
from cohortlens.operators.accounts import first_churn, last_use
from cohortlens.sources.tables import Tables

ACTIVITY_RATE = "product_retention_rate_percentage"
FIRST_CHURN_RATE = "payment_retention_rate_till_first_churn_percentage"
LAST_CHURN_RATE = "payment_retention_rate_till_last_churn_percentage"


def active_months(t: Tables) -> DataFrame:
    """account_id, active_months: the set of months with usage.

    Usage is reduced to distinct (subscription, month) before the join to
    subscriptions - a hot subscription shrinks to at most one row per calendar
    month - and to one set per account after it, by one exchange that carries
    what each task has collected.  A set holds at most the calendar's months,
    whatever the account's rows, and it meets the accounts where it lies."""
    per_sub = (t.pick("feature_usage", "subscription_id", "usage_date").where("usage_date is not null")
               .selectExpr("subscription_id", "trunc(usage_date, 'MM') as active_month").distinct())
    return (per_sub.join(t.pick("subscriptions", "subscription_id", "account_id"), "subscription_id")
            .groupBy("account_id").agg(F.collect_set("active_month").alias("active_months")))


def _activity_tenure(cohorts: DataFrame, active: DataFrame) -> DataFrame:
    """``cohorts`` (account_id, cohort_month, ...) with tenure: the length of
    the unbroken run of active months from the cohort month on, less one (-1:
    not active in its first month).

    Sorted month numbers without repeats are 0, 1, 2, ... as long as no month
    is missing, so the run is the numbers that equal their place."""
    number = lambda m: age_months(F.col("cohort_month"), m)
    numbers = F.array_sort(F.filter(F.transform("active_months", number), lambda n: n >= 0))
    run = F.size(F.filter(numbers, lambda n, place: n == place))
    return (cohorts.join(active, "account_id", "left")
            .select(*cohorts.columns, (F.coalesce(F.when(F.col("active_months").isNotNull(), run), F.lit(0)) - 1).cast("long").alias("tenure")))


def retention_activity(t: Tables) -> DataFrame:
    """Unbroken-activity retention per signup cohort, in one pass over
    accounts; the streak length per account goes through the same tenure
    histogram as payment retention."""
    cohorts = t.pick("accounts", "account_id", "signup_date").select("account_id", month_of(F.col("signup_date")).alias("cohort_month"))
    return _from_tenure(_activity_tenure(cohorts, active_months(t)), ACTIVITY_RATE)


def _from_tenure(per_account: DataFrame, rate_col: str) -> DataFrame:
    """Retention from one row per account: cohort_month and tenure, the last
    month number it is counted in (< 0: counted in no month, but in its
    cohort's size).

    Accounts per (cohort, tenure) - a partially aggregated group-by whose
    output is bounded by the calendar - become "accounts with tenure >= k" by
    a reverse running sum per cohort; each histogram row emits only the
    month numbers between the previous tenure and its own, so the work is
    proportional to the result."""
    hist = (per_account.groupBy("cohort_month", "tenure")
            .agg(F.count("account_id").alias("n")))
    by_cohort = Window.partitionBy("cohort_month")
    up = by_cohort.orderBy("tenure")
    down = by_cohort.orderBy(F.col("tenure").desc()).rowsBetween(Window.unboundedPreceding,
                                                                 Window.currentRow)
    h = (hist.withColumn("cohort_size", F.sum("n").over(by_cohort))
         .where(F.col("tenure") >= 0)
         .withColumn("prev", F.lag("tenure").over(up))
         .withColumn("active_accounts", F.sum("n").over(down)))
    k = F.explode(F.sequence(F.coalesce(F.col("prev") + 1, F.lit(0)), F.col("tenure")))
    out = h.where(F.col("cohort_month").isNotNull()) \
        .select("cohort_month", k.alias("month_number"), "active_accounts", "cohort_size")
    return (out.select("cohort_month", F.col("month_number").cast("long").alias("month_number"),
                       F.col("active_accounts").cast("long").alias("active_accounts"),
                       F.col("cohort_size").cast("long").alias("cohort_size"),
                       pct(F.col("active_accounts"), F.col("cohort_size")).alias(rate_col))
            .orderBy("cohort_month", "month_number"))


def _payment_retention(span: DataFrame, rate_col: str) -> DataFrame:
    """``span``: one row per account with account_id, cohort_month and
    last_month.  Cohort sizes come from the same rows, so accounts are read
    once."""
    tenure = age_months(F.col("cohort_month"), F.col("last_month"))
    return _from_tenure(span.select("account_id", "cohort_month", tenure.alias("tenure")), rate_col)


def _span(t: Tables, last_churn: DataFrame, churn_col: str) -> DataFrame:
    max_date = last_use(t)
    return (t.pick("accounts", "account_id", "signup_date")
            .join(last_churn, "account_id", "left")
            .select("account_id", month_of(F.col("signup_date")).alias("cohort_month"),
                    month_of(F.coalesce(F.col(churn_col), max_date)).alias("last_month")))


def retention_payment_first(t: Tables) -> DataFrame:
    """Payment retention until the first churn."""
    span = _span(t, first_churn(t), "first_churn_date")
    return _payment_retention(span, FIRST_CHURN_RATE)


def retention_payment_last(t: Tables) -> DataFrame:
    """Payment retention until the last churn."""
    last = t.pick("churn_events", "account_id", "churn_date").groupBy("account_id").agg(F.max("churn_date").alias("last_churn_date"))
    span = _span(t, last, "last_churn_date")
    return _payment_retention(span, LAST_CHURN_RATE)


#: Month numbers of the matrix's columns unless others are given: ten years.
MATRIX_MONTHS = range(120)


def retention_matrix(retention: DataFrame, rate_col: str, months=MATRIX_MONTHS) -> DataFrame:
    """Cohort (``yyyy-MM``) x month_number matrix of the rate.

    The columns are the given ``months``, so the plan needs no look at the
    data; missing cells are NULL.  A cell must come from exactly one row, and
    no row may lie outside the columns: either raises (both are checked on the
    way, without a pass of their own)."""
    months = list(months)
    number = F.col("month_number")
    covered = (F.when(number.isin(months), number)
               .otherwise(F.raise_error(F.lit("retention_matrix: a month number has no column")).cast("long")))
    cell = (F.when(F.count(F.lit(1)) > 1,
                   F.raise_error(F.lit("retention_matrix: duplicate (cohort, month_number) cell")))
            .otherwise(F.max(rate_col)).cast("double"))
    return (retention.select(F.date_format("cohort_month", "yyyy-MM").alias("cohort_m_short"),
                             covered.alias("month_number"), rate_col)
            .groupBy("cohort_m_short").pivot("month_number", months).agg(cell).orderBy("cohort_m_short"))


def retention_mean(retention: DataFrame, rate_col: str, months=(0, 12)) -> DataFrame:
    """Unweighted mean over cohorts of the rate at the given month
    numbers; cohorts without that month are not in the mean.  The mean is
    taken on exact hundredths, so the result does not depend on summation
    order."""
    return retention.where(F.col("month_number").isin(list(months))).agg(*_means(rate_col, months))


def _means(rate_col: str, months) -> list[Column]:
    cents = F.round(F.col(rate_col) * 100).cast("long")
    aggs = []
    for m in months:
        hit = F.col("month_number") == m
        aggs.append((F.sum(F.when(hit, cents)).cast("double")
                     / F.nullif(F.count(F.when(hit, cents)) * 100, F.lit(0)).cast("double"))
                    .alias(f"mean_month_{m}"))
    return aggs


def retention_means(activity: DataFrame, first: DataFrame, last: DataFrame, months=(0, 12)) -> DataFrame:
    """J28 for three stored retention tables: one row per kind with the mean
    rate at each of ``months``."""
    out = None
    for name, df, rate in (("activity", activity, ACTIVITY_RATE),
                           ("payment_first_churn", first, FIRST_CHURN_RATE),
                           ("payment_last_churn", last, LAST_CHURN_RATE)):
        m = retention_mean(df, rate, months).select(F.lit(name).alias("retention"), "*")
        out = m if out is None else out.unionByName(m)
    return out


def retention_means_of(t: Tables, months=(0, 12)) -> DataFrame:
    """J28 from the inputs, in one pass: an account's three tenures (streak,
    until its first and its last churn) come from one join of accounts with
    one churn aggregate, are stacked, and go through one histogram per kind
    and cohort.  Only the asked month numbers are computed, so nothing is
    expanded."""
    churn = t.pick("churn_events", "account_id", "churn_date").groupBy("account_id").agg(
        F.min("churn_date").alias("_first"), F.max("churn_date").alias("_last"))
    max_date = last_use(t)
    cohort = month_of(F.col("signup_date"))
    until = lambda c: age_months(cohort, month_of(F.coalesce(F.col(c), max_date)))
    spans = (t.pick("accounts", "account_id", "signup_date").join(churn, "account_id", "left")
             .select("account_id", cohort.alias("cohort_month"), until("_first").alias("_t1"), until("_last").alias("_t2")))
    streaks = _activity_tenure(spans, active_months(t))
    kinds = streaks.select("cohort_month", F.expr(
        "stack(3, 'activity', tenure, 'payment_first_churn', cast(_t1 as bigint), "
        "'payment_last_churn', cast(_t2 as bigint)) as (retention, tenure)"))
    per_cohort = kinds.groupBy("retention", "cohort_month").agg(
        F.count(F.lit(1)).alias("size"), *[F.count_if(F.col("tenure") >= m).alias(f"n{m}") for m in months])
    per_cohort = per_cohort.where(F.col("cohort_month").isNotNull())
    cells = []
    for m in months:
        rate = F.when(F.col(f"n{m}") > 0, F.round(pct(F.col(f"n{m}"), F.col("size")) * 100).cast("long"))
        cells.append((F.sum(rate).cast("double") / F.nullif(F.count(rate) * 100, F.lit(0)).cast("double"))
                     .alias(f"mean_month_{m}"))
    return per_cohort.groupBy("retention").agg(*cells)
