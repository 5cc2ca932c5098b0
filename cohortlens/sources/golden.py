"""Result tables as published by the source analysis: CSV with a quoted
header, ISO dates, empty field = NULL.  Read with explicit schemas, never
inferred (J36), and previewed with ``limit``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RETENTION = "cohort_month DATE, month_number INT, active_accounts BIGINT, cohort_size BIGINT, {} DECIMAL(5,2)"

SCHEMAS = {
    "mom_growth": ("month DATE, new_customers BIGINT, running_total_new_customers BIGINT, "
                   "mom_growth_percentage DECIMAL(9,2)"),
    "churn_segments": ("segment STRING, subsegment STRING, total_accounts BIGINT, "
                       "churned_accounts BIGINT, churned_share_percentage DECIMAL(5,2)"),
    "retention_activity_based": RETENTION.format("product_retention_rate_percentage"),
    "retention_first_churn_based": RETENTION.format("payment_retention_rate_till_first_churn_percentage"),
    "retention_last_churn_based": RETENTION.format("payment_retention_rate_till_last_churn_percentage"),
    "median_activation_time_days": ("median_subscription_from_signup_time_days DOUBLE, "
                                    "median_usage_from_signup_time_days DOUBLE"),
    "usage_data_agg": "total_count BIGINT, valid_usage_data BIGINT, invalid_usage_data BIGINT",
    "monthly_active_users": "active_month DATE, mau BIGINT",
    "usage_segments": ("usage_segment STRING, accounts BIGINT, segment_share_percentage DECIMAL(5,2), "
                       "churned_accounts BIGINT, churn_rate_percentage DECIMAL(5,2), "
                       "avg_lifetime_months DECIMAL(9,2)"),
}


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    return (spark.read.schema(SCHEMAS[name])
            .option("header", True).option("quote", '"').option("emptyValue", None)
            .option("mode", "FAILFAST").csv(path))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def frame(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """Build a result table from in-memory rows (dates as ISO text, rates as
    numbers): the DataFrame that ``read`` returns, rates as DOUBLE."""
    schema = SCHEMAS[name].replace("DECIMAL(5,2)", "DOUBLE").replace("DECIMAL(9,2)", "DOUBLE")
    fields = [c.strip().split(" ")[0] for c in schema.split(",")]
    df = spark.createDataFrame(rows, ", ".join(
        f"{f} STRING" if "DATE" in part else part for f, part in zip(fields, schema.split(","))))
    for f, part in zip(fields, schema.split(",")):
        if "DATE" in part:
            df = df.withColumn(f, F.to_date(F.col(f)))
    return df
