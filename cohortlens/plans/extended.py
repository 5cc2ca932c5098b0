"""Queries over stored and maintained forms of the inputs: name -> f(spark, sf_dir).

They give the results of the jobs they are named after, by another way: a
bucketed layout, a summary refreshed after a change, a stream with keyed state,
stored sketches, files written and read again.  Each writes what it needs to a
new folder below ``spark.checkpoint.dir`` when it is called; the returned
DataFrame reads from there.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.operators import accounts as acc, activation as act, activity, churn, growth, quality
from cohortlens.operators import retention as ret, sketches, usage_segments as seg
from cohortlens.plans.incremental import SummaryStore, touched_by
from cohortlens.session import checkpoint_root
from cohortlens.sources import exchange, layout, schema
from cohortlens.sources.sinks import materialize
from cohortlens.sources.tables import (
    Tables, load_driver_tables, map_accounts, map_churn_events, map_subscriptions, read_driver_table,
)
from cohortlens.streaming import keyed
from cohortlens.streaming.mau import usage_stream_from_driver_files

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_root(spark), "extended", f"{name}-{uuid.uuid4().hex[:12]}")


# --- bucketed layout -----------------------------------------------------------

def _bucketed(job: Callable[[Tables], DataFrame]) -> Query:
    return lambda s, d: job(layout.store(s, load_driver_tables(s, d)).tables())


def _segments_bucketed(t: Tables) -> DataFrame:
    return seg.usage_segments(t, acc.account_outcomes(
        t, ("account_id", "signup_date", "churn_flag", "lifetime_months_till_churn")))


# --- incremental summary ----------------------------------------------------------

#: Orders from this day on are the change that the summary is refreshed by.
LATE = dt.date(2001, 7, 1)


def with_orders(spark: SparkSession, sf_dir: str, orders: DataFrame) -> Tables:
    """The inputs with other orders than the stored ones."""
    read = lambda n: read_driver_table(spark, sf_dir, n)
    return load_driver_tables(spark, sf_dir).with_(
        accounts=lambda columns: map_accounts(read("customer"), lambda: read("nation"), lambda: orders, columns),
        subscriptions=lambda columns: map_subscriptions(orders, columns),
        churn_events=lambda columns: map_churn_events(orders, columns))


def summary_after_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run over the orders before ``LATE``, refreshed by the later ones."""
    orders = read_driver_table(spark, sf_dir, "orders")
    late = orders.where(F.col("o_orderdate") >= F.lit(LATE))
    store = SummaryStore(spark, _folder(spark, "summary"))
    store.create(with_orders(spark, sf_dir, orders.where(F.col("o_orderdate") < F.lit(LATE))))
    t = load_driver_tables(spark, sf_dir)
    store.refresh(t, touched_by(t, subscriptions=map_subscriptions(late, ("account_id",))))
    return store.current()


# --- keyed stream ---------------------------------------------------------------

def mau_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usage files through the stream with keyed state, then the counts it published."""
    root = _folder(spark, "mau-keyed")
    usage = usage_stream_from_driver_files(spark, os.path.join(sf_dir, "lineitem*.parquet"))
    t = load_driver_tables(spark, sf_dir)
    keyed.start(usage, t, root, state_partitions=layout.default_buckets(t)).awaitTermination()
    return keyed.current(spark, root)


# --- sketches -------------------------------------------------------------------

def mau_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 from stored daily sketches beside the exact counts: is each within the stated bound?"""
    t = load_driver_tables(spark, sf_dir)
    estimates = sketches.monthly_estimates(materialize(sketches.daily_sketches(t), "daily-sketches"))
    exact = activity.monthly_active_users(t, ordered=False)
    return (exact.join(estimates, "active_month", "left")
            .select("active_month", "mau", sketches.within("mau_estimate", "mau", sketches.error_bound()).alias("within_bound")))


def census_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J01 from stored sketches per start month beside the exact counts."""
    subs = load_driver_tables(spark, sf_dir).pick("subscriptions", "subscription_id", "account_id", "start_date")
    estimate = sketches.census_estimates(materialize(sketches.census_sketches(subs), "census-sketches"))
    exact, bound = quality.key_census(subs), sketches.error_bound()
    joined = exact.join(estimate.select("count_rows", F.col("count_subs").alias("s"), F.col("count_accounts").alias("a")), "count_rows")
    return joined.select("count_rows", "count_subs", "count_accounts",
                         (sketches.within("s", "count_subs", bound) & sketches.within("a", "count_accounts", bound)).alias("within_bound"))


# --- files ------------------------------------------------------------------------

GROWTH = "month DATE, new_customers BIGINT, running_total_new_customers BIGINT, mom_growth_percentage DOUBLE"
SEGMENTS = ("segment STRING, subsegment STRING, total_accounts BIGINT, churned_accounts BIGINT, "
            "churned_share_percentage DOUBLE")


def _through_csv(df: DataFrame, ddl: str) -> DataFrame:
    root = _folder(df.sparkSession, "csv")
    exchange.export(df, root)
    loaded = exchange.load(df.sparkSession, root, ddl)
    bad = loaded.rejected.agg(F.count(F.lit(1))).scalar()
    return loaded.rows.withColumn("rows_committed", F.lit(loaded.expected).cast("long")).withColumn("malformed_lines", bad)


def growth_through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, exported as CSV, committed, loaded with its schema."""
    subs = load_driver_tables(spark, sf_dir).pick("subscriptions", "account_id", "start_date")
    return _through_csv(growth.customer_growth(subs), GROWTH)


def segments_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20 through CSV, then its first five rows in order."""
    t = load_driver_tables(spark, sf_dir)
    segments = churn.churn_by_segment(acc.account_outcomes(t, (*[c for _, c in churn.SEGMENTS], "churn_flag")))
    return exchange.preview(_through_csv(segments, SEGMENTS), 5, ["segment", "subsegment"])


#: Text that can't be read, planted in the export: column -> (modulus, remainder, text).
PLANTED = {"start_date": (97, 5, "1995-02-30"), "end_date": (89, 7, "soon"), "mrr_amount": (83, 1, "n/a"),
           "upgrade_flag": (79, 3, "maybe")}


def subscriptions_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subscriptions written as text with some unreadable values, loaded by the
    checked ingest: typed columns, and the reasons of the rows in quarantine."""
    subs = load_driver_tables(spark, sf_dir).pick("subscriptions", *schema.SUBSCRIPTIONS.fieldNames())
    key = F.col("subscription_id")
    text = []
    for c in subs.columns:
        shown = F.coalesce(F.col(c).cast("string"), F.lit(""))
        if c in PLANTED:
            modulus, remainder, bad = PLANTED[c]
            shown = F.when(key % modulus == remainder, F.lit(bad)).otherwise(shown)
        text.append(shown.alias(c))
    root = _folder(spark, "text")
    subs.select(*text).write.option("header", True).option("emptyValue", "").csv(os.path.join(root, "subscriptions.csv"))
    raw = spark.read.schema(", ".join(f"{c} STRING" for c in subs.columns)).option("header", True) \
        .option("emptyValue", "").csv(os.path.join(root, "subscriptions.csv"))
    good, bad = schema.quarantine(raw, "subscriptions")
    told = F.array_join(F.transform(schema.REASONS, lambda r: F.concat(r["column"], F.lit("="), r["text"])), ";")
    both = good.withColumn("reasons", F.lit("")).unionByName(
        schema.checked(bad, "subscriptions").select(*good.columns, told.alias("reasons")))
    return both.select(*[F.col(c).cast("long").alias(c) for c in ("subscription_id", "account_id", "mrr_amount")],
                       "start_date", "end_date", "plan_tier", "upgrade_flag", "downgrade_flag", "reasons")


def churn_rate_by_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19 as SQL over views: the inputs' and the summary's."""
    t = load_driver_tables(spark, sf_dir)
    prefix = f"view_{uuid.uuid4().hex[:8]}_"
    t.register_views(prefix)
    acc.accounts_summary(t).createOrReplaceTempView(f"{prefix}accounts_summary")
    return spark.sql(f"""
        select count_if(churn_flag = 1) as churned_accounts,
               cast(100 * count_if(churn_flag = 1) as double) / nullif(count(*), 0) as churn_rate_percentage,
               (select count(distinct account_id) from {prefix}churn_events) as accounts_with_events
        from {prefix}accounts_summary""")


EXTENDED: dict[str, Query] = {
    "feature_metrics_bucketed": _bucketed(acc.feature_metrics),
    "monthly_active_users_bucketed": _bucketed(activity.monthly_active_users),
    "retention_activity_bucketed": _bucketed(ret.retention_activity),
    "usage_segments_bucketed": _bucketed(_segments_bucketed),
    "accounts_summary_incremental": summary_after_orders,
    "monthly_active_users_keyed": mau_keyed,
    "monthly_active_users_sketch": mau_by_sketch,
    "key_census_sketch": census_by_sketch,
    "activation_median_histogram": lambda s, d: act.activation_median_by_histogram(
        act.activation_base(load_driver_tables(s, d))),
    "customer_growth_filled": lambda s, d: growth.customer_growth(
        load_driver_tables(s, d).pick("subscriptions", "account_id", "start_date"), fill_gaps=True),
    "customer_growth_csv": growth_through_csv,
    "churn_segments_preview": segments_preview,
    "subscriptions_from_text": subscriptions_from_text,
    "churn_rate_views": churn_rate_by_views,
}
