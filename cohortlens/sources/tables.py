"""Input tables of the jobs and the mapping from the driver's TPC-H-like
Parquet tables onto them.

The mapping is fixed (see FIXTURES.md section 3) and is a pure projection of
each driver table, except ``accounts.signup_date``, which needs the first
order date per customer (one partial aggregation of ``orders``).  Every read
is a Parquet scan that Catalyst prunes to the used columns; filters on the
mapped columns stay pushable because the mapping keeps the source columns
untouched inside simple casts.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLE_NAMES = ("accounts", "subscriptions", "feature_usage", "support_tickets", "churn_events")


class Tables:
    """The five inputs of every job, already typed (see ``schema.py``).

    Each input is a DataFrame or a function that gives one for the columns it
    is asked for (None: all).  ``pick`` asks for the columns a job needs, so
    the others - and what only they need, like a joined dimension - are never
    planned; ``t.accounts`` and the like are whole tables.  A function is
    called on first use only: a job that reads two tables never plans the
    other three.

    ``hot_accounts``: the accounts with very many subscriptions
    (``skew.hot_keys``), stored once by a run of many jobs; without it, each
    skew-safe join counts them itself."""

    def __init__(self, accounts, subscriptions, feature_usage, support_tickets, churn_events,
                 hot_accounts: DataFrame | None = None):
        self.hot_accounts = hot_accounts
        self._src: dict[str, DataFrame | Callable[[tuple[str, ...] | None], DataFrame]] = dict(
            accounts=accounts, subscriptions=subscriptions, feature_usage=feature_usage,
            support_tickets=support_tickets, churn_events=churn_events)
        self._built: dict[tuple, DataFrame] = {}

    def _get(self, name: str, columns: tuple[str, ...] | None = None) -> DataFrame:
        if (name, columns) not in self._built:
            src = self._src[name]
            if not isinstance(src, DataFrame):
                src = src(columns)
            elif columns:
                src = src.select(*columns)
            self._built[name, columns] = src
        return self._built[name, columns]

    def pick(self, name: str, *columns: str) -> DataFrame:
        """The named columns of one input, in that order."""
        return self._get(name, columns)

    accounts = property(lambda self: self._get("accounts"))
    subscriptions = property(lambda self: self._get("subscriptions"))
    feature_usage = property(lambda self: self._get("feature_usage"))
    support_tickets = property(lambda self: self._get("support_tickets"))
    churn_events = property(lambda self: self._get("churn_events"))

    def with_(self, **kw) -> "Tables":
        """Other inputs or hot accounts; these don't outlive their subscriptions."""
        kept = {} if "subscriptions" in kw else {"hot_accounts": self.hot_accounts}
        return Tables(**{**self._src, **kept, **kw})

    def register_views(self, prefix: str = "") -> None:
        """Expose the five inputs as temporary views (``<prefix><table>``) so
        SQL written against the source tables runs through ``spark.sql``;
        the plans are the same as with the DataFrame API."""
        for name in TABLE_NAMES:
            self._get(name).createOrReplaceTempView(f"{prefix}{name}")


# The mapping (FIXTURES.md section 3): each input column as SQL over a driver
# table.  A job's columns are one projection, parsed at once.
DATE = "cast({} as date)"
MRR = "cast(floor(o_totalprice / 100) as bigint)"
ACCOUNT_COLUMNS = {
    "account_id": "c_custkey",
    "industry": "c_mktsegment",
    "country": "n_name",
    "signup_date": "date_sub(coalesce(first_order, date'1995-01-01'), cast(c_custkey % 30 as int))",
    "referral_source": ("case c_custkey % 5 when 0 then 'ads' when 1 then 'event' when 2 then 'organic' "
                        "when 3 then 'other' else 'partner' end"),
    "plan_tier": "case c_custkey % 3 when 0 then 'Basic' when 1 then 'Pro' else 'Enterprise' end",
    "seats": "cast(1 + c_custkey % 50 as bigint)",
}
SUBSCRIPTION_COLUMNS = {
    "subscription_id": "o_orderkey",
    "account_id": "o_custkey",
    "start_date": DATE.format("o_orderdate"),
    "end_date": ("case when o_orderstatus = 'F' then date_add(cast(o_orderdate as date), "
                 "cast(30 + o_orderkey % 365 as int)) end"),
    "plan_tier": ("case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Enterprise' "
                  "when o_orderpriority = '3-MEDIUM' then 'Pro' else 'Basic' end"),
    "seats": "case when o_orderkey % 13 <> 0 then cast(1 + o_orderkey % 50 as bigint) end",
    "mrr_amount": MRR,
    "arr_amount": f"case when o_orderkey % 17 <> 0 then {MRR} * 12 end",
    "is_trial": "case when o_orderkey % 19 <> 0 then o_orderkey % 9 = 0 end",
    "upgrade_flag": "o_orderkey % 7 = 0",
    "downgrade_flag": "o_orderkey % 11 = 0",
    "churn_flag": "case when o_orderkey % 29 <> 0 then o_orderstatus = 'F' end",
    "billing_frequency": ("case o_orderkey % 6 when 5 then null when 4 then '' when 0 then 'monthly' "
                          "when 2 then 'monthly' else 'annual' end"),
    "auto_renew_flag": "case when o_orderkey % 23 <> 0 then o_orderkey % 5 <> 0 end",
}
USAGE_COLUMNS = {
    "subscription_id": "l_orderkey",
    "usage_date": DATE.format("l_shipdate"),
    "feature_name": "concat('feature_', cast(l_partkey % 40 as string))",
    "usage_count": "cast(l_quantity as bigint)",
    "error_count": "cast(l_linenumber % 3 as bigint)",
    "is_beta_feature": "l_partkey % 10 = 0",
}
CHURN_COLUMNS = {
    "churn_event_id": "o_orderkey",
    "account_id": "o_custkey",
    "churn_date": "date_add(cast(o_orderdate as date), 30)",
    "reason_code": "case o_orderkey % 4 when 0 then 'pricing' when 1 then 'support' when 2 then 'features' else 'unknown' end",
    "refund_amount_usd": "case when o_orderkey % 3 = 0 then cast(floor(o_totalprice / 1000) as bigint) else 0L end",
}
TICKET_COLUMNS = {
    "ticket_id": "event_id",
    "account_id": "user_id",
    "resolution_time_hours": "cast(value as double)",
    "satisfaction_score": "cast(case when event_id % 3 = 0 then null else 1 + event_id % 5 end as double)",
    "escalation_flag": "event_id % 10 = 0",
}

Columns = tuple[str, ...] | None


def _mapped(df: DataFrame, exprs: dict[str, str], columns: Columns = None) -> DataFrame:
    return df.selectExpr(*[f"{exprs[c]} as {c}" for c in columns or exprs])


def map_accounts(customer: DataFrame, nation: Callable[[], DataFrame], orders: Callable[[], DataFrame],
                 columns: Columns = None) -> DataFrame:
    """The country joins nations, the signup date the first orders: only where
    asked for."""
    wanted = columns or tuple(ACCOUNT_COLUMNS)
    df = customer
    if "country" in wanted:
        df = df.join(nation(), F.expr("c_nationkey = n_nationkey"), "left")
    if "signup_date" in wanted:
        first = orders().groupBy("o_custkey").agg(F.expr("min(cast(o_orderdate as date)) as first_order"))
        df = df.join(first, F.expr("c_custkey = o_custkey"), "left")
    return _mapped(df, ACCOUNT_COLUMNS, columns)


def map_subscriptions(orders: DataFrame, columns: Columns = None) -> DataFrame:
    return _mapped(orders, SUBSCRIPTION_COLUMNS, columns)


def map_feature_usage(lineitem: DataFrame, columns: Columns = None) -> DataFrame:
    return _mapped(lineitem, USAGE_COLUMNS, columns)


def map_churn_events(orders: DataFrame, columns: Columns = None) -> DataFrame:
    return _mapped(orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"), CHURN_COLUMNS, columns)


def map_support_tickets(events: DataFrame, columns: Columns = None) -> DataFrame:
    return _mapped(events.where("event_type = 'error'"), TICKET_COLUMNS, columns)


# Schemas of the driver columns the mapping reads.  Declared, never inferred:
# inference would open Parquet footers in an extra job on every read.
DRIVER_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING",
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
               "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                 "l_shipdate TIMESTAMP_NTZ"),
    "events": "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE",
}


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    return reader.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy plans over the driver Parquet files; nothing runs here."""
    read = lambda n: read_driver_table(spark, sf_dir, n)
    return Tables(
        accounts=lambda columns: map_accounts(read("customer"), lambda: read("nation"), lambda: read("orders"), columns),
        subscriptions=lambda columns: map_subscriptions(read("orders"), columns),
        feature_usage=lambda columns: map_feature_usage(read("lineitem"), columns),
        support_tickets=lambda columns: map_support_tickets(read("events"), columns),
        churn_events=lambda columns: map_churn_events(read("orders"), columns),
    )


def load_raw_tables(spark: SparkSession, root: str, pattern: str = "{table}.csv",
                    fmt: str = "csv", options: dict | None = None) -> Tables:
    """The five source tables as exported text (dates as text, missing
    subscription end as the empty string), typed once by ``schema.ingest``.

    Every column is read as text - the header names the columns, nothing is
    inferred - so a malformed value becomes NULL in ``ingest`` and shows up
    in the null audit and in ``schema.rejects`` instead of failing the read."""
    from cohortlens.sources.schema import ingest

    opts = {"header": "true", "emptyValue": "", "nullValue": "\\N", **(options or {})}

    def read(table: str, columns: Columns) -> DataFrame:
        path = os.path.join(root, pattern.format(table=table))
        header = spark.read.options(**opts).format(fmt).load(path).columns
        text = ", ".join(f"`{c}` STRING" for c in header)
        typed = ingest(spark.read.options(**opts).schema(text).format(fmt).load(path), table)
        return typed.select(*columns) if columns else typed

    return Tables(**{n: (lambda columns, n=n: read(n, columns)) for n in TABLE_NAMES})


def load_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """Read already-typed input tables stored as ``<root>/<table>`` (for
    example written by ``sinks.materialize_tables``)."""
    r = lambda n: spark.read.format(fmt).load(os.path.join(root, n))
    return Tables(r("accounts"), r("subscriptions"), r("feature_usage"),
                  r("support_tickets"), r("churn_events"))
