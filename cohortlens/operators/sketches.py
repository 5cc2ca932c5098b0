"""Distinct counts as stored, mergeable sketches.

A HyperLogLog sketch of the accounts active on a day is a few kilobytes however
many rows the day has.  Stored per day, sketches are merged to months - or any
other span - without reading usage again, and a new day adds one row per day
instead of a recount.  ``lg_k`` sets their size; with 2^lg_k registers the
relative standard error of a count is 1.04 / sqrt(2^lg_k), and ``error_bound``
states ``sigmas`` of it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions import month_of
from cohortlens.operators.activity import active_days
from cohortlens.sources.tables import Tables

LG_K = 14


def error_bound(lg_k: int = LG_K, sigmas: float = 4.0) -> float:
    """Relative error that an estimate exceeds about once in 16,000 (4 sigmas)."""
    return sigmas * 1.04 / math.sqrt(1 << lg_k)


def daily_sketches(t: Tables, lg_k: int = LG_K) -> DataFrame:
    """day, accounts: a sketch of the accounts active on each day (to be stored)."""
    return (active_days(t).groupBy(F.col("usage_date").alias("day"))
            .agg(F.hll_sketch_agg("account_id", lg_k).alias("accounts")))


def monthly_estimates(daily: DataFrame) -> DataFrame:
    """active_month, mau_estimate from stored daily sketches alone."""
    return (daily.groupBy(month_of(F.col("day")).alias("active_month"))
            .agg(F.hll_sketch_estimate(F.hll_union_agg("accounts")).alias("mau_estimate")))


def census_sketches(subscriptions: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Per start month: rows, and sketches of subscriptions and accounts (J01's keys)."""
    return (subscriptions.groupBy(month_of(F.col("start_date")).alias("month"))
            .agg(F.count(F.lit(1)).alias("count_rows"), F.hll_sketch_agg("subscription_id", lg_k).alias("subs"),
                 F.hll_sketch_agg("account_id", lg_k).alias("accounts")))


def census_estimates(sketches: DataFrame) -> DataFrame:
    """J01 from stored sketches: rows exactly, distinct keys by estimate."""
    return sketches.agg(F.sum("count_rows").alias("count_rows"),
                        F.hll_sketch_estimate(F.hll_union_agg("subs")).alias("count_subs"),
                        F.hll_sketch_estimate(F.hll_union_agg("accounts")).alias("count_accounts"))


def within(estimate: str, exact: str, bound: float):
    """Is the estimate within the relative bound?"""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.col(exact) * F.lit(bound)
