"""Streaming MAU equals the batch job on the same usage rows."""

import datetime as dt
import os

from cohortlens.operators import activity
from cohortlens.sources.tables import load_driver_tables, read_driver_table
from cohortlens.streaming import mau as smau
from conftest import SF_SMALL, make_tables


def _published(spark, root):
    return sorted(tuple(r) for r in smau.current(spark, root).collect())


def _batch(t):
    return sorted(tuple(r) for r in activity.monthly_active_users(t).collect())


def test_streaming_mau_equals_batch(spark, tmp_path):
    usage = smau.usage_stream_from_driver_files(spark, os.path.join(SF_SMALL, "lineitem*.parquet"))
    root = str(tmp_path / "mau")
    assert _published(spark, root) == []
    smau.start(usage, lambda s: load_driver_tables(s, SF_SMALL), root).awaitTermination(300)
    assert _published(spark, root) == _batch(load_driver_tables(spark, SF_SMALL)) != []


def test_resumes_and_counts_a_repeated_batch_once(spark, tmp_path):
    """Usage arrives in two drops; the second run resumes from the checkpoint.
    A batch processed again after a failure changes nothing."""
    load = lambda s: load_driver_tables(s, SF_SMALL)
    lineitem = read_driver_table(spark, SF_SMALL, "lineitem")
    land, root = str(tmp_path / "landing"), str(tmp_path / "mau")

    def run():
        usage = smau.usage_stream_from_driver_files(spark, land + "/*/*.parquet")
        smau.start(usage, load, root).awaitTermination(300)

    lineitem.where("l_orderkey % 2 = 0").write.parquet(land + "/drop1")
    run()
    first = _published(spark, root)
    lineitem.where("l_orderkey % 2 = 1").write.parquet(land + "/drop2")
    run()
    want = _batch(load(spark))
    assert first and first != want and _published(spark, root) == want
    from cohortlens.sources.tables import map_feature_usage
    smau.process(map_feature_usage(spark.read.schema(lineitem.schema).parquet(land + "/drop2")), 1, load, root)
    assert _published(spark, root) == want


def test_late_rows_and_late_subscriptions_count(spark, tmp_path):
    """A use that arrives after a newer month's counts, and a subscription
    that was unknown when the stream was built, are both seen."""
    day = dt.date
    accounts = [dict(account_id=i, signup_date=day(2024, 1, 1)) for i in (1, 2)]
    subs = [dict(subscription_id=10, account_id=1, start_date=day(2024, 1, 1))]
    root = str(tmp_path / "mau")

    def load(_):
        return make_tables(spark, accounts=accounts, subscriptions=subs)

    def use(*rows):
        return make_tables(spark, usage=[dict(subscription_id=s, usage_date=d) for s, d in rows]).feature_usage

    smau.process(use((10, day(2024, 2, 1))), 0, load, root)
    subs.append(dict(subscription_id=20, account_id=2, start_date=day(2024, 1, 5)))
    smau.process(use((10, day(2024, 1, 31)), (20, day(2024, 2, 2)), (20, day(2024, 1, 31))), 1, load, root)
    assert _published(spark, root) == [(day(2024, 1, 1), 2), (day(2024, 2, 1), 2)]
