"""Churn overall and by segment (J19, J20), per country (J29-J31, share in
J35) and the notebook's segment helpers (J32, J33).

All of these read the per-account outcomes (dimensions, churn_flag,
lifetime) once.  The four segment breakdowns are one pass: ``stack`` turns
each account row into four (segment, subsegment) rows inside the scan stage
and a single partially aggregated group-by counts them - instead of four
scans joined by UNION ALL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions import pct, ratio

# Segment name -> summary column, in the source's output order.
SEGMENTS = (
    ("industry", "industry"),
    ("country", "country"),
    ("referral_source", "referral_source"),
    ("initial_plan_tier", "initial_plan_tier"),
)

def _churned():
    return F.col("churn_flag") == 1


def churn_rate(outcomes: DataFrame) -> DataFrame:
    """Churned accounts and unrounded churn rate in percent."""
    churned = F.count_if(_churned())
    return outcomes.agg(churned.alias("churned_accounts"),
                        ratio(churned * 100, F.count(F.lit(1))).alias("churn_rate_percentage"))


def churn_by_segment(outcomes: DataFrame, segments=SEGMENTS) -> DataFrame:
    """Accounts, churned accounts and churn share (%, 2 decimals) per
    subsegment of each segment; ordered by segment, then share descending."""
    args = []
    for name, column in segments:
        args += [F.lit(name), F.col(column).cast("string")]
    long = outcomes.select(F.stack(F.lit(len(segments)), *args).alias("segment", "subsegment"),
                           "churn_flag")
    counts = (long.groupBy("segment", "subsegment")
              .agg(F.count(F.lit(1)).alias("total_accounts"),
                   F.count_if(_churned()).alias("churned_accounts")))
    return (counts.withColumn("churned_share_percentage",
                              pct(F.col("churned_accounts"), F.col("total_accounts")))
            .orderBy(F.col("segment").asc_nulls_last(),
                     F.col("churned_share_percentage").desc_nulls_first()))


def _known_country(outcomes: DataFrame) -> DataFrame:
    # A pandas group-by drops NULL keys; Spark keeps them.
    return outcomes.where(F.col("country").isNotNull())


def country_accounts(outcomes: DataFrame) -> DataFrame:
    """Accounts per country, ascending."""
    return (_known_country(outcomes).groupBy("country")
            .agg(F.count("account_id").alias("accounts"))
            .orderBy("accounts", "country"))


def country_churn(outcomes: DataFrame) -> DataFrame:
    """Churned accounts per country, ascending."""
    return (_known_country(outcomes).groupBy("country")
            .agg(F.sum("churn_flag").cast("long").alias("churned_accounts"))
            .orderBy("churned_accounts", "country"))


def country_lifetime(outcomes: DataFrame) -> DataFrame:
    """Mean lifetime in months per country (unrounded), ascending."""
    life = F.col("lifetime_months_till_churn")
    return (_known_country(outcomes).groupBy("country")
            .agg(ratio(F.sum(life), F.count(life)).alias("avg_lifetime_months"))
            .orderBy("avg_lifetime_months", "country"))


def country_share(outcomes: DataFrame) -> DataFrame:
    """Accounts per country and their share of all accounts with a
    known country (%, 2 decimals)."""
    per_country = _known_country(outcomes).groupBy("country") \
        .agg(F.count("account_id").alias("accounts"))
    total = F.sum("accounts").over(Window.partitionBy())  # one row per country
    return (per_country.withColumn("share_percentage", pct(F.col("accounts"), total))
            .orderBy(F.col("accounts").desc(), "country"))


def segment_sizes(churn_segments: DataFrame) -> DataFrame:
    """Number of subsegments per segment and the cumulative count in
    output order (the divider positions of the segment chart)."""
    w = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (churn_segments.groupBy("segment").agg(F.count(F.lit(1)).alias("subsegments"))
            .withColumn("cumulative_subsegments", F.sum("subsegments").over(w))
            .withColumn("divider_position", F.col("cumulative_subsegments") - F.lit(0.5))
            .orderBy("segment"))


def worst_subsegment(churn_segments: DataFrame) -> DataFrame:
    """The subsegment with the highest churn share in each segment
    (ties: alphabetically first)."""
    rate = F.col("churned_share_percentage")
    best = F.min_by(F.struct(F.col("subsegment"), rate.alias("r")),
                    F.struct(-rate, F.col("subsegment")))
    return (churn_segments.groupBy("segment").agg(best.alias("w"))
            .select("segment", F.col("w.subsegment").alias("subsegment"),
                    F.col("w.r").alias("churned_share_percentage"))
            .orderBy("segment"))
