"""Stored and maintained forms of the inputs: layout, incremental summary, keyed
stream, sketches, histogram percentiles, CSV exchange, checked ingest, spine."""

import datetime as dt
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from cohortlens.functions.quantiles import exact_percentiles
from cohortlens.operators import accounts as acc, activity, growth, retention as ret, sketches
from cohortlens.operators import usage_segments as seg
from cohortlens.plans import extended
from cohortlens.plans.extended import EXTENDED
from cohortlens.plans.incremental import SummaryStore, touched_by
from cohortlens.sources import exchange, layout, schema
from cohortlens.sources.tables import load_driver_tables, map_subscriptions, read_driver_table
from cohortlens.streaming import keyed
from cohortlens.streaming.mau import usage_stream_from_driver_files
from conftest import SF_SMALL, d, make_tables, rows


@pytest.fixture(scope="module")
def tables(spark):
    return load_driver_tables(spark, SF_SMALL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "nation", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return con


def _sorted(found, cols):
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(norm(r[c]) for c in cols) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(EXTENDED))
def test_query_matches_oracle(spark, duck, name):
    assert EXTENDED[name] is queries()[name]
    df = EXTENDED[name](spark, SF_SMALL)
    res = duck.execute(oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == sorted(df.columns)
    assert _sorted(df.collect(), names) == _sorted([dict(zip(names, r)) for r in res.fetchall()], names)


# --- layout ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def stored(spark, tables):
    made = layout.store(spark, tables)
    yield made
    made.drop()


def _plan(df) -> str:
    """The plan as at scale: nothing small enough to broadcast by itself."""
    spark = df.sparkSession
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "-1")
    spark.conf.set(keys[1], "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _way_up(plan: str, scan: str) -> list[str]:
    """Operators from the first scan of ``scan`` up to the root."""
    lines = [line for line in plan.split("\n") if line.strip()]
    at = next(i for i, line in enumerate(lines) if scan in line and "Scan" in line and "subscription_id" in line)
    depth = lambda line: len(re.match(r"[\s:+\-*|]*", line).group())
    way, here = [], depth(lines[at])
    for line in reversed(lines[:at + 1]):
        if depth(line) < here or line is lines[at]:
            way.append(line.strip(" :+-"))
            here = depth(line)
    return way


JOBS = {"J09": acc.feature_metrics, "J15": activity.monthly_active_users, "J21": ret.retention_activity,
        "J24": lambda t: seg.usage_segments(t, acc.account_outcomes(t))}


@pytest.mark.parametrize("job", sorted(JOBS))
def test_usage_is_exchanged_once(stored, job):
    """No exchange of usage below or at its join with subscriptions; then one, of
    rows reduced per account.  What is exchanged after that is one row per account,
    month or band."""
    way = _way_up(_plan(JOBS[job](stored.tables())), "usage_")
    exchanges = [i for i, op in enumerate(way) if "Exchange hashpartitioning" in op]
    join = next(i for i, op in enumerate(way) if "Join" in op)
    assert join < exchanges[0], way
    assert "account_id" in way[exchanges[0]], way
    after = [way[i] for i in exchanges[1:]]
    # J09's second one is of per-account sums; J15's, J21's and J24's of rows per month, cohort or band
    assert all("usage_date" not in op and "subscription_id" not in op and "feature_name" not in op for op in after), after
    assert len(after) <= {"J09": 1, "J15": 1, "J21": 2, "J24": 1}[job], way


def test_layout_has_one_file_per_bucket_and_month(spark, stored, tables):
    usage = spark.table(stored.usage)
    files = usage.inputFiles()
    assert len(files) <= stored.buckets * usage.select(layout.MONTH).distinct().count()
    assert usage.agg(F.sum("usage_count")).first()[0] == tables.feature_usage.agg(F.sum("usage_count")).first()[0]


def test_months_are_partitions(spark, stored, tables):
    t = stored.in_months(dt.date(1997, 3, 5), dt.date(1997, 4, 1))
    plan = t.feature_usage._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*usage_month", plan)
    got = rows(activity.monthly_active_users(t))
    assert got == [r for r in rows(activity.monthly_active_users(tables)) if r[0] in (d("1997-03-01"), d("1997-04-01"))] and got


def test_layout_keeps_nulls_and_orphans(spark):
    t = make_tables(spark, accounts=[dict(account_id=1, signup_date="2024-01-01")],
                    subscriptions=[dict(subscription_id=10, account_id=1, start_date="2024-01-01")],
                    usage=[dict(subscription_id=10, usage_date="2024-01-02", feature_name="a", usage_count=2, is_beta_feature=None),
                           dict(subscription_id=10, usage_date="2024-01-02", feature_name="a", usage_count=3, is_beta_feature=True),
                           dict(subscription_id=None, usage_date="2024-01-03", feature_name="b", usage_count=1),
                           dict(subscription_id=99, usage_date=None, feature_name=None, usage_count=None)])
    made = layout.store(spark, t, buckets=2)
    assert sorted(map(str, rows(acc.feature_metrics(made.tables())))) == sorted(map(str, rows(acc.feature_metrics(t))))
    assert rows(activity.monthly_active_users(made.tables())) == rows(activity.monthly_active_users(t))
    made.drop()


@pytest.mark.parametrize("rows_held", [0, 3_600_000, 36_000_000, 216_000_000])
def test_a_bucket_stays_small_as_usage_grows(spark, rows_held):
    """Jobs hold a bucket's groups in one task: more usage gives more buckets, not larger ones."""
    t = make_tables(spark).with_(feature_usage=spark.range(rows_held).withColumnRenamed("id", "subscription_id"))
    buckets = layout.default_buckets(t)
    assert buckets >= layout.LEAST_BUCKETS and rows_held / buckets <= 1_000_000
    assert buckets <= max(layout.LEAST_BUCKETS, rows_held / 500_000)     # a month has a file in each


def test_the_reduction_reads_small_splits(spark, tables, monkeypatch):
    """While the layout is written, a task reads little of a file whatever the session's setting."""
    before, seen = spark.conf.get(layout.SPLITS), []
    save = type(tables.subscriptions.write).saveAsTable
    monkeypatch.setattr(type(tables.subscriptions.write), "saveAsTable",
                        lambda self, *a, **kw: seen.append(spark.conf.get(layout.SPLITS)) or save(self, *a, **kw))
    layout.store(spark, tables, buckets=2).drop()
    assert seen == [str(16 << 20)] * 2 and spark.conf.get(layout.SPLITS) == before
    with pytest.raises(RuntimeError), layout._small_splits(spark):
        raise RuntimeError("lost")
    assert spark.conf.get(layout.SPLITS) == before


# --- incremental summary -----------------------------------------------------------

def _orders(spark):
    return read_driver_table(spark, SF_SMALL, "orders")


def test_refresh_recomputes_touched_accounts_only(spark, tables, tmp_path):
    orders = _orders(spark)
    late = orders.where("o_orderkey % 50 = 3")
    store = SummaryStore(spark, str(tmp_path / "summary"), buckets=16)
    before_t = extended.with_orders(spark, SF_SMALL, orders.where("o_orderkey % 50 <> 3"))
    store.create(before_t)
    before = {r.account_id: r for r in store.current().collect()}
    assert before == {r.account_id: r for r in acc.accounts_summary(before_t).collect()}
    touched = touched_by(tables, subscriptions=map_subscriptions(late, ("account_id",)))
    ids = {r.account_id for r in touched.collect()}
    assert 0 < len(ids) < len(before)
    assert store.refresh(tables, touched) == 1
    after = {r.account_id: r for r in store.current().collect()}
    assert after == {r.account_id: r for r in acc.accounts_summary(tables).collect()}
    assert {a for a in after if after[a] != before.get(a)} <= ids
    # buckets without a touched account are still read from the first version
    held, _ = store._manifest(1)
    hit = {r.bucket for r in store._bucketed(touched).select("bucket").distinct().collect()}
    assert {b for b, v in held.items() if v == 1} == hit
    assert {r.account_id: r for r in store.current(0).collect()} == before


def test_refresh_restricts_before_aggregating(spark, tables):
    """Untouched accounts never reach the aggregates: the inputs are semi-joined first."""
    from cohortlens.plans.incremental import restricted
    touched = spark.createDataFrame([(1,), (2,)], "account_id long")
    part = restricted(tables, touched)
    assert {r.account_id for r in acc.accounts_summary(part).collect()} <= {1, 2}
    owners = tables.subscriptions.where("account_id in (1, 2)").count()
    assert part.subscriptions.count() == owners


def test_last_usage_date_moves(spark, tmp_path):
    """A new last date touches the accounts that depend on it, without being told."""
    accounts = [dict(account_id=i, signup_date="2024-01-01", seats=1) for i in range(1, 6)]
    subs = [dict(subscription_id=10 + i, account_id=i, start_date="2024-01-10", mrr_amount=10,
                 end_date="2024-02-01" if i == 3 else None) for i in (1, 2, 3, 4)]
    subs.append(dict(subscription_id=22, account_id=4, start_date="2024-03-15", mrr_amount=7))   # after its churn
    churn = [dict(churn_event_id=i, account_id=i, churn_date="2024-03-01", refund_amount_usd=0) for i in (2, 3, 4)]
    use = [dict(subscription_id=11, usage_date="2024-05-01", feature_name="a", usage_count=1, error_count=0)]

    def load(*more, **extra):
        return make_tables(spark, accounts=accounts, subscriptions=subs, churn=churn, usage=[*use, *more], **extra)

    store = SummaryStore(spark, str(tmp_path / "summary"), buckets=4)
    store.create(load())
    new = dict(subscription_id=12, usage_date="2024-09-01", feature_name="b", usage_count=5, error_count=1)
    t = load(new)
    store.refresh(t, touched_by(t, feature_usage=make_tables(spark, usage=[new]).feature_usage))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(store.current()) == key(acc.accounts_summary(t))
    assert store.refresh(t, t.accounts.select("account_id").limit(0)) == 1          # nothing touched, no version
    gone = t.with_(accounts=t.accounts.where("account_id <> 5"))
    store.refresh(gone, spark.createDataFrame([(5,)], "account_id long"))
    assert key(store.current()) == key(acc.accounts_summary(gone))
    store.expire(keep=1)
    assert store.versions() == [2] and key(store.current()) == key(acc.accounts_summary(gone))


def test_refresh_that_died_leaves_the_version_before(spark, tables, tmp_path, monkeypatch):
    store = SummaryStore(spark, str(tmp_path / "summary"), buckets=4)
    store.create(tables)
    monkeypatch.setattr(SummaryStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    some = tables.pick("accounts", "account_id").where("account_id < 5")
    with pytest.raises(RuntimeError):
        store.refresh(tables, some)
    assert store.versions() == [0]
    monkeypatch.undo()
    assert store.refresh(tables, some) == 1
    assert _sorted(store.current().collect(), acc.SUMMARY_COLUMNS) == \
        _sorted(acc.accounts_summary(tables).collect(), acc.SUMMARY_COLUMNS)


def test_empty_store(spark, tmp_path):
    t = make_tables(spark)
    store = SummaryStore(spark, str(tmp_path / "summary"), buckets=4)
    store.create(t)
    assert store.current().collect() == []


# --- keyed stream ------------------------------------------------------------------

def test_keyed_stream_resumes(spark, tables, tmp_path):
    """Several drops: every pair counts once, versions don't pile up, a repeated batch changes nothing."""
    lineitem = read_driver_table(spark, SF_SMALL, "lineitem")
    land, root = str(tmp_path / "landing"), str(tmp_path / "mau")
    assert keyed.current(spark, root).collect() == []
    for drop in range(5):
        lineitem.where(f"l_orderkey % 5 <= {drop} and l_linenumber % 5 = {drop}").write.parquet(f"{land}/drop{drop}")
        lineitem.where(f"l_orderkey % 5 > {drop} and l_linenumber % 5 = {drop}").write.parquet(f"{land}/rest{drop}")
        usage = usage_stream_from_driver_files(spark, land + "/*/*.parquet")
        keyed.start(usage, tables, root).awaitTermination()
    want = sorted(rows(activity.monthly_active_users(tables)))
    assert sorted(rows(keyed.current(spark, root), "active_month", "mau")) == want
    versions = keyed._versions(spark, root)
    assert len(versions) <= keyed.KEPT_VERSIONS
    again = spark.createDataFrame([(1, d("1997-01-01"))], "account_id long, active_month date")
    before = rows(keyed.current(spark, root))
    keyed.publish(again.limit(0), versions[-1] + 1, root)
    keyed.publish(again.limit(0), versions[-1] + 1, root)
    assert sorted(rows(keyed.current(spark, root), "active_month", "mau")) == sorted(before)


class _State:
    """A state store of one value per account that counts the calls to it."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def test_an_account_costs_one_read_and_one_write():
    from pyspark.sql import Row
    state, processor = _State(), keyed.NewMonths()
    processor.init(state)

    def batch(*parts):
        state.calls.clear()
        return [r.asDict() for r in processor.handleInputRows((7,), iter([Row(active_months=list(p)) for p in parts]), None)]

    assert batch([24001, 24000], [24001, 24050]) == [dict(account_id=7, active_months=[24000, 24001, 24050])]
    assert state.calls == ["get", "update"]
    assert batch([24000], [24050]) == [] and state.calls == ["get"]
    assert batch([24000, 23999]) == [dict(account_id=7, active_months=[23999])]
    assert state.calls == ["get", "update"] and state.value == ([23999, 24000, 24001, 24050],)


def test_months_reach_the_state_as_one_row_per_account(spark):
    pairs = spark.createDataFrame([(i % 3, d(f"19{90 + i % 5}-0{1 + i % 7}-01")) for i in range(500)],
                                  "account_id long, active_month date").repartition(1)
    got = keyed._months_per_account(pairs).collect()
    assert sorted(r.account_id for r in got) == [0, 1, 2]
    want = {(r.account_id, 12 * r.active_month.year + r.active_month.month - 1) for r in pairs.collect()}
    assert sorted((r.account_id, m) for r in got for m in r.active_months) == sorted(want)
    assert keyed._months_per_account(pairs.limit(0)).collect() == []


def test_counts_are_published_without_one_task_for_all_partitions(spark, tmp_path):
    pairs = spark.createDataFrame([(i, d("1997-01-01")) for i in range(40)], "account_id long, active_month date")
    narrowed = []
    coalesce = type(pairs).coalesce
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(pairs), "coalesce", lambda df, n: narrowed.append(n) or coalesce(df, n))
        keyed.publish(pairs, 0, str(tmp_path))
    assert not narrowed
    assert rows(keyed.current(spark, str(tmp_path))) == [(d("1997-01-01"), 40)]
    assert len([f for f in os.listdir(tmp_path / "mau" / "0") if f.endswith(".parquet")]) == 1


# --- sketches ------------------------------------------------------------------------

def test_sketches_are_merged_without_usage(spark, tables):
    from cohortlens.sources.sinks import materialize
    daily = materialize(sketches.daily_sketches(tables), "daily")
    monthly = sketches.monthly_estimates(daily)
    plan = monthly._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "daily-" in plan
    exact = dict(rows(activity.monthly_active_users(tables)))
    got = dict(rows(monthly))
    assert set(got) == set(exact)
    assert all(abs(got[m] - n) <= n * sketches.error_bound() for m, n in exact.items())


# --- percentiles -----------------------------------------------------------------------

@pytest.mark.parametrize("bins", [None, 1, 7])
def test_percentiles_equal_percentile_cont(spark, bins):
    values = [("a", float(x * x % 97)) for x in range(200)] + [("b", 5.0), ("c", None), ("d", -1.5), ("d", 2.5)] + \
        [(None, 3.0)] * 4 + [("e", 7.0)] * 50
    df = spark.createDataFrame(values, "g string, v double").repartition(5)
    df = df.withColumn("g", F.coalesce("g", F.lit("null")))
    ps = [0.0, 0.1, 0.5, 0.95, 1.0]
    want = df.where("v is not null").groupBy("g").agg(*[F.expr(f"percentile_cont({p}) within group (order by v)").alias(f"p{i}")
                                                        for i, p in enumerate(ps)])
    got = exact_percentiles(df, ["g"], "v", ps, bins)
    assert _sorted(got.collect(), got.columns) == _sorted(want.collect(), got.columns)


# --- CSV, ingest, spine ------------------------------------------------------------------

DDL = "day DATE, n BIGINT, rate DOUBLE, name STRING"
GOOD = [(d("2024-01-31"), 1, 0.5, "plain"), (None, None, None, None), (d("2024-02-29"), -3, 1e-9, 'quoted "x", and, commas'),
        (d("1999-12-31"), 0, 33.33, "éß")]


def test_export_and_load(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame(GOOD, DDL)
    with pytest.raises(exchange.IncompleteExport):
        exchange.load(spark, root, DDL)
    exchange.export(df.limit(1), root)
    exchange.export(df.repartition(3), root)
    loaded = exchange.load(spark, root, DDL)
    assert loaded.expected == 4 and loaded.rejected.count() == 0
    assert sorted(map(str, loaded.rows.collect())) == sorted(map(str, df.collect()))


def test_an_export_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    df = spark.createDataFrame(GOOD, DDL)
    exchange.export(df.limit(2), root)
    with monkeypatch.context() as m:
        m.setattr(exchange, "_files", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            exchange.export(df, root)
    assert exchange.load(spark, root, DDL).rows.count() == 2
    folder = exchange.export(df, root)
    part = next(f for f in os.listdir(folder) if f.startswith("part-") and f.endswith(".csv"))
    os.remove(os.path.join(folder, part))
    with pytest.raises(exchange.IncompleteExport):
        exchange.load(spark, root, DDL)


def test_malformed_lines_come_back_whole(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('day,n,rate,name\n2024-01-31,1,0.5,a\n2024-02-30,1,0.5,bad day\n2024-01-31,x,0.5,bad number\n'
                    '2024-01-31,1,0.5\n2024-01-31,1,0.5,a,too many\n,,,\n')
    good, bad = exchange.read_checked(spark, str(path), DDL)
    assert good.count() == 2 and good.select("name").where("name = 'a'").count() == 1
    assert sorted(r._bad_line for r in bad.collect()) == sorted(
        ["2024-02-30,1,0.5,bad day", "2024-01-31,x,0.5,bad number", "2024-01-31,1,0.5", "2024-01-31,1,0.5,a,too many"])
    assert bad.count() == 4 and all(r.file.endswith("in.csv") for r in bad.collect())


def test_a_wrong_header_raises(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("day,count,rate,name\n2024-01-31,1,0.5,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        exchange.read_checked(spark, str(path), DDL)[0].collect()


def test_quarantine(spark):
    names = schema.CHURN_EVENTS.fieldNames()
    raw = spark.createDataFrame([("1", "7", "2024-01-31", "pricing", "10.50"), ("2", "7", "31.01.2024", "x", "5"),
                                 ("3", "8", " ", None, ""), ("4", None, "2023-02-29", "y", "ten")], names)
    good, bad = schema.quarantine(raw, "churn_events")
    assert good.columns == names and sorted(r.churn_event_id for r in good.collect()) == ["1", "3"]
    told = {r.churn_event_id: [(x["column"], x.text) for x in r.reject_reasons] for r in bad.collect()}
    assert told == {"2": [("churn_date", "31.01.2024")], "4": [("churn_date", "2023-02-29"), ("refund_amount_usd", "ten")]}
    assert bad.select(*names).where("churn_event_id = '4'").first().refund_amount_usd == "ten"


def test_growth_with_filled_months(spark):
    t = make_tables(spark, subscriptions=[dict(subscription_id=i, account_id=i, start_date=s) for i, s in enumerate(
        ["2024-01-05", "2024-01-06", "2024-04-01", "2024-05-01", "2024-05-09", None], 1)])
    got = rows(growth.customer_growth(t.subscriptions, fill_gaps=True))
    assert got == [(d("2024-01-01"), 2, 2, None), (d("2024-02-01"), 0, 2, -100.0), (d("2024-03-01"), 0, 2, None),
                   (d("2024-04-01"), 1, 3, None), (d("2024-05-01"), 2, 5, 100.0), (None, 1, 6, -50.0)]
    empty = make_tables(spark)
    assert rows(growth.customer_growth(empty.subscriptions, fill_gaps=True)) == []


def test_matrix_months_are_a_setting(spark):
    from cohortlens.plans.registry import MATRIX_SETTING, QUERIES
    spark.conf.set(MATRIX_SETTING, "200")
    try:
        wide = QUERIES["retention_matrix"](spark, SF_SMALL)
        assert wide.columns == ["cohort_m_short", *map(str, range(200))]
        narrow_cols = ["cohort_m_short", *map(str, range(120))]
        got = _sorted(wide.collect(), narrow_cols)
    finally:
        spark.conf.unset(MATRIX_SETTING)
    narrow = QUERIES["retention_matrix"](spark, SF_SMALL)
    assert narrow.columns == narrow_cols and _sorted(narrow.collect(), narrow_cols) == got


def test_entry_survives_a_missing_library():
    """Without a library that only the training-data operators use, the others stay."""
    import subprocess
    import sys
    code = ("import sys; sys.modules['ahocorasick'] = None\n"
            "import warnings; warnings.simplefilter('ignore')\n"
            "import __spark_entry__ as e; q = e.queries(); assert len(q) == 53 and set(q) == set(e.oracle_sql()), len(q)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
