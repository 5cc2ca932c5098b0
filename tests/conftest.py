from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from cohortlens.session import local_session  # noqa: E402
from cohortlens.sources import schema as S  # noqa: E402
from cohortlens.sources.tables import Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8)
    yield s
    s.stop()


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def _df(spark, rows, schema):
    fixed = []
    for r in rows:
        vals = []
        for f in schema.fields:
            v = r.get(f.name) if isinstance(r, dict) else None
            if isinstance(v, str) and f.dataType.typeName() == "date":
                v = d(v)
            if v is not None and f.dataType.typeName() == "decimal":
                v = Decimal(str(v))
            vals.append(v)
        fixed.append(tuple(vals))
    return spark.createDataFrame(fixed, schema)


def make_tables(spark, accounts=(), subscriptions=(), usage=(), tickets=(), churn=()) -> Tables:
    """Typed input tables from dicts; missing columns are NULL."""
    long_keys = lambda s: S.with_key_type(s, T.LongType())
    return Tables(
        accounts=_df(spark, accounts, long_keys(S.ACCOUNTS)),
        subscriptions=_df(spark, subscriptions, long_keys(S.SUBSCRIPTIONS)),
        feature_usage=_df(spark, usage, long_keys(S.FEATURE_USAGE)),
        support_tickets=_df(spark, tickets, long_keys(S.SUPPORT_TICKETS)),
        churn_events=_df(spark, churn, long_keys(S.CHURN_EVENTS)),
    )


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.collect()]
