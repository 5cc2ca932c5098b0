"""Data checks on subscriptions: key census (J01) and null audit.

Both are single global aggregates over one scan.  The census's two exact
distinct counts share one pass (Catalyst expands each row once per distinct
key and de-duplicates map-side); ``approx=True`` swaps in HyperLogLog++ for
a shuffle-free estimate on very large tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Audit output names of the source, per subscriptions column.
NULL_AUDIT_NAMES = (
    ("subscription_id", "subs_nulls"),
    ("account_id", "account_nulls"),
    ("start_date", "start_date_nulls"),
    ("end_date", "end_date_nulls"),
    ("plan_tier", "plan_tier_nulls"),
    ("seats", "seats_nulls"),
    ("mrr_amount", "mrr_amount_nulls"),
    ("arr_amount", "arr_amount_nulls"),
    ("is_trial", "is_trial_nulls"),
    ("upgrade_flag", "upgrade_nulls"),
    ("downgrade_flag", "downgrade_nulls"),
    ("churn_flag", "churn_nulls"),
    ("billing_frequency", "billing_nulls"),
    ("auto_renew_flag", "auto_renew_nulls"),
)


def key_census(subscriptions: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, distinct subscriptions, distinct accounts."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return subscriptions.agg(F.count(F.lit(1)).alias("count_rows"),
                             distinct("subscription_id").alias("count_subs"),
                             distinct("account_id").alias("count_accounts"))


def null_audit(subscriptions: DataFrame, blanks: bool = True) -> DataFrame:
    """NULL count of each of the fourteen audited columns, plus - for
    text columns - the count of blank values, which also mean "missing" in the
    source but are not NULL.  An absent column raises."""
    absent = [c for c, _ in NULL_AUDIT_NAMES if c not in subscriptions.columns]
    if absent:
        raise ValueError(f"null_audit: subscriptions lacks {', '.join(absent)}")
    aggs = [F.count_if(F.col(c).isNull()).alias(name) for c, name in NULL_AUDIT_NAMES]
    if blanks:
        text = {f.name for f in subscriptions.schema.fields if f.dataType.typeName() == "string"}
        aggs += [F.count_if(F.trim(F.col(c)) == "").alias(f"{c}_blanks")
                 for c, _ in NULL_AUDIT_NAMES if c in text]
    return subscriptions.agg(*aggs)
