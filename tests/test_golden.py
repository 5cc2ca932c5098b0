"""Golden replay: the notebook-side jobs on the published result tables, and
the published invariants of those tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import activation as act
from cohortlens.operators import activity, churn, growth, retention as ret
from cohortlens.sources import golden
import golden_values as G


def _date(s):
    return dt.date.fromisoformat(s)


def test_month_labels_and_trend(spark):
    g = golden.frame(spark, "mom_growth", G.MOM_GROWTH)
    out = growth.mom_trend(growth.month_labels(g)).orderBy("month").collect()
    assert [r.month_short for r in out][:2] == ["2023-01", "2023-02"]
    trend = {r.month_short: r.trend for r in out}
    assert trend["2023-01"] == "positive"  # NULL change
    assert trend["2023-05"] == "negative" and trend["2024-07"] == "positive"
    assert sum(t == "negative" for t in trend.values()) == 10


def test_growth_invariants():
    assert sum(r[1] for r in G.MOM_GROWTH) == G.MOM_GROWTH[-1][2] == 500
    pcts = [r[3] for r in G.MOM_GROWTH if r[3] is not None]
    assert (min(pcts), max(pcts)) == (-44.44, 300.0)


def test_segment_sizes_and_worst_subsegment(spark):
    seg = golden.frame(spark, "churn_segments", G.CHURN_SEGMENTS)
    sizes = [(r.segment, r.subsegments, r.cumulative_subsegments, r.divider_position)
             for r in churn.segment_sizes(seg).collect()]
    assert sizes == [("country", 7, 7, 6.5), ("industry", 5, 12, 11.5),
                     ("initial_plan_tier", 3, 15, 14.5), ("referral_source", 5, 20, 19.5)]
    worst = {r.segment: r.subsegment for r in churn.worst_subsegment(seg).collect()}
    assert worst == G.WORST


def test_segment_invariants():
    for s in {r[0] for r in G.CHURN_SEGMENTS}:
        part = [r for r in G.CHURN_SEGMENTS if r[0] == s]
        assert sum(r[2] for r in part) == 500 and sum(r[3] for r in part) == 352
    assert sum(r[1] for r in G.USAGE_SEGMENTS) == 500
    assert sum(r[3] for r in G.USAGE_SEGMENTS) == 352
    assert round(sum(r[2] for r in G.USAGE_SEGMENTS), 2) == 100.0


def test_usage_quality_split(spark):
    q = spark.createDataFrame([G.USAGE_DATA_AGG], "total_count long, valid_usage_data long, invalid_usage_data long")
    out = act.usage_quality_split(q).collect()[0]
    assert tuple(out) == (10, 490)
    assert out.valid_usage_data + out.invalid_usage_data <= G.USAGE_DATA_AGG[0]


def test_mau_summary(spark):
    mau = golden.frame(spark, "monthly_active_users", G.MONTHLY_ACTIVE_USERS)
    r = activity.mau_summary(mau).collect()[0]
    assert (r.mean_mau, r.peak_month, r.peak_mau) == (G.MEAN_MAU, _date(G.PEAK[0]), G.PEAK[1])


def test_country_share_from_segments(spark):
    # accounts per country in the published segment table -> 58.2% US, 11.6% UK
    rows = [(sub, total) for seg, sub, total, _, _ in G.CHURN_SEGMENTS if seg == "country"]
    per_account = spark.createDataFrame(rows, "country string, n long") \
        .select("country", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("account_id"))
    share = {r.country: r.share_percentage for r in churn.country_share(per_account).collect()}
    assert share["US"] == 58.2 and share["UK"] == 11.6


def test_golden_csv_reader_schema(spark, tmp_path):
    p = tmp_path / "mom_growth.csv"
    p.write_text('"month","new_customers","running_total_new_customers","mom_growth_percentage"\n'
                 "2023-01-01,2,2,\n2023-02-01,8,10,300.00\n")
    df = golden.read(spark, "mom_growth", str(p))
    assert dict(df.dtypes) == {"month": "date", "new_customers": "bigint",
                               "running_total_new_customers": "bigint",
                               "mom_growth_percentage": "decimal(9,2)"}
    assert [tuple(r) for r in df.collect()][0] == (_date("2023-01-01"), 2, 2, None)
    assert golden.preview(df).count() == 2


def test_published_retention_means(spark):
    """The published rates at months 0 and 12 give the published means."""
    cohorts = [_date(f"{y}-{m:02d}-01") for y in (2023, 2024) for m in range(1, 13)]
    for kind, rate in (("activity", ret.ACTIVITY_RATE), ("payment_first_churn", ret.FIRST_CHURN_RATE),
                       ("payment_last_churn", ret.LAST_CHURN_RATE)):
        rows = [(c, m, r) for m, rates in G.RETENTION_RATES[kind].items() for c, r in zip(cohorts, rates)]
        table = spark.createDataFrame(rows, f"cohort_month date, month_number int, {rate} double")
        mean = ret.retention_mean(table, rate).first()
        assert (round(mean.mean_month_0, 2), round(mean.mean_month_12, 2)) == G.RETENTION_MEANS[kind]
        matrix = ret.retention_matrix(table, rate, (0, 12)).collect()
        assert [r.cohort_m_short for r in matrix] == [f"{c:%Y-%m}" for c in cohorts]
        assert [r["0"] for r in matrix] == G.RETENTION_RATES[kind][0]


@pytest.mark.skipif("PUBLISHED_RESULTS" not in os.environ, reason="needs the folder of published result files")
def test_published_files_are_read_with_their_schemas(spark):
    tables = {n: golden.read(spark, n, f"{os.environ['PUBLISHED_RESULTS']}/{n}.csv") for n in golden.SCHEMAS}
    sizes = {n: df.count() for n, df in tables.items()}
    assert sizes["mom_growth"] == 24 and sizes["churn_segments"] == 20 and min(sizes.values()) >= 1
    assert all(golden.preview(df).count() == min(5, sizes[n]) for n, df in tables.items())


def test_every_result_schema_reads_its_csv(spark, tmp_path):
    for name, schema in golden.SCHEMAS.items():
        row = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in
                                      spark.createDataFrame([], schema).schema.fields])
        row.write.option("header", True).csv(str(tmp_path / name))
        back = golden.read(spark, name, str(tmp_path / name))
        assert back.schema.simpleString() == row.schema.simpleString()
        assert golden.preview(back).count() == 1
