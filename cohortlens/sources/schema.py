"""Typed schemas of the five input tables and the text-to-type ingest step.

The source system keeps every date as text and a missing subscription end as
the empty string.  ``ingest`` converts once, at the edge: dates become
``DateType`` (so later predicates push down to Parquet as date filters) and
blank text becomes NULL.  Keys are text (source identifiers such as
``A-2e4581``); money is ``DECIMAL(18,2)``.  The driver mapping produces
BIGINT keys and whole-number amounts instead - every job accepts either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ACCOUNTS = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("signup_date", T.DateType()),
    T.StructField("referral_source", T.StringType()),
    T.StructField("plan_tier", T.StringType()),
    T.StructField("seats", T.LongType()),
])

SUBSCRIPTIONS = T.StructType([
    T.StructField("subscription_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("plan_tier", T.StringType()),
    T.StructField("mrr_amount", T.DecimalType(18, 2)),
    T.StructField("upgrade_flag", T.BooleanType()),
    T.StructField("downgrade_flag", T.BooleanType()),
])

# Columns of the source subscriptions table that the driver mapping does not
# produce; they are audited when present (null_audit) and typed on ingest.
SUBSCRIPTIONS_OPTIONAL = T.StructType([
    T.StructField("seats", T.LongType()),
    T.StructField("arr_amount", T.DecimalType(18, 2)),
    T.StructField("is_trial", T.BooleanType()),
    T.StructField("churn_flag", T.BooleanType()),
    T.StructField("billing_frequency", T.StringType()),
    T.StructField("auto_renew_flag", T.BooleanType()),
])

FEATURE_USAGE = T.StructType([
    T.StructField("subscription_id", T.StringType()),
    T.StructField("usage_date", T.DateType()),
    T.StructField("feature_name", T.StringType()),
    T.StructField("usage_count", T.LongType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("is_beta_feature", T.BooleanType()),
])

SUPPORT_TICKETS = T.StructType([
    T.StructField("ticket_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("resolution_time_hours", T.DoubleType()),
    T.StructField("satisfaction_score", T.DoubleType()),
    T.StructField("escalation_flag", T.BooleanType()),
])

CHURN_EVENTS = T.StructType([
    T.StructField("churn_event_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("churn_date", T.DateType()),
    T.StructField("reason_code", T.StringType()),
    T.StructField("refund_amount_usd", T.DecimalType(18, 2)),
])

KEYS = ("account_id", "subscription_id", "ticket_id", "churn_event_id")


def with_key_type(schema: T.StructType, dtype: T.DataType) -> T.StructType:
    """The same schema with every key column of type ``dtype``."""
    return T.StructType([T.StructField(f.name, dtype if f.name in KEYS else f.dataType, f.nullable)
                         for f in schema.fields])


SCHEMAS = {
    "accounts": ACCOUNTS,
    "subscriptions": SUBSCRIPTIONS,
    "feature_usage": FEATURE_USAGE,
    "support_tickets": SUPPORT_TICKETS,
    "churn_events": CHURN_EVENTS,
}


def _text(c: Column) -> Column:
    """Trimmed text; blank is NULL."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def _typed(c: Column, dtype: T.DataType) -> Column:
    """Text (or any type) to ``dtype``; blank or whitespace-only text is NULL,
    and so is a value that cannot be read as ``dtype``."""
    if isinstance(dtype, T.StringType):
        return c.cast("string")
    if isinstance(dtype, T.BooleanType):
        text = F.lower(_text(c))
        return (F.when(text.isin("true", "t", "1", "yes", "y"), F.lit(True))
                .when(text.isin("false", "f", "0", "no", "n"), F.lit(False)))
    return _text(c).try_cast(dtype)


def _fields(raw: DataFrame, table: str) -> list[T.StructField]:
    absent = [f.name for f in SCHEMAS[table].fields if f.name not in raw.columns]
    if absent:
        raise ValueError(f"{table}: missing columns {', '.join(absent)}")
    optional = SUBSCRIPTIONS_OPTIONAL.fields if table == "subscriptions" else []
    return [*SCHEMAS[table].fields, *(f for f in optional if f.name in raw.columns)]


def ingest(raw: DataFrame, table: str) -> DataFrame:
    """Type a raw (text) table: one projection, no shuffle.

    A missing column of the schema raises; optional subscription columns are
    kept typed when present, other extras are dropped.  Malformed values
    become NULL; ``rejects`` counts them.
    """
    return raw.select(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in _fields(raw, table)])


REASONS = "reject_reasons"


def _reasons(raw: DataFrame, table: str) -> Column:
    """Array of (column, text) of the values that are not blank and can't be read."""
    bad = [F.when(_text(F.col(f.name)).isNotNull() & _typed(F.col(f.name), f.dataType).isNull(),
                  F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("text")))
           for f in _fields(raw, table)]
    return F.filter(F.array(*bad), lambda r: r.isNotNull())


def checked(raw: DataFrame, table: str) -> DataFrame:
    """``ingest`` with a last column ``reject_reasons``, empty for a good row."""
    return raw.select(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in _fields(raw, table)],
                      _reasons(raw, table).alias(REASONS))


def quarantine(raw: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, typed; bad rows as they came, with ``reject_reasons``): a row is
    bad if any value can't be read.  Nothing is lost, so a load can be repaired
    and its bad rows ingested again."""
    marked = raw.withColumn(REASONS, _reasons(raw, table))
    return ingest(marked.where(F.size(REASONS) == 0), table), marked.where(F.size(REASONS) > 0)


def rejects(raw: DataFrame, table: str) -> DataFrame:
    """One row: per column, how many values that are not blank ``ingest``
    cannot read."""
    return raw.agg(*[F.count_if(_text(F.col(f.name)).isNotNull() & _typed(F.col(f.name), f.dataType).isNull())
                     .alias(f.name) for f in _fields(raw, table)])
