"""Stored layout of the inputs: usage partitioned by month and co-located with
subscriptions.

``store`` writes two tables whose rows lie in the same number of buckets by
``subscription_id``:

* usage, one row per (subscription, day, feature), partitioned by usage month
  and sorted by subscription inside a file.  Every job reads usage through
  sums, maxima and distinct sets over these keys, so results are those of the
  raw rows; a subscription with a third of all rows has at most one row per day
  and feature here, so no bucket grows with it;
* subscriptions.

Jobs over the returned ``Tables`` are unchanged: aggregations by subscription
and the join of usage to subscriptions need no exchange, as Spark knows the
buckets; ``in_months`` reads the partitions of the months asked for only.

The rows are reduced in tasks, shuffled once by the reduction and once by
subscription, so that a month has one file per bucket.  What a task holds doesn't
grow with the tables: scans that reduce rows take ``SPLIT_BYTES`` of a file, and
jobs over the layout, which aggregate and sort a bucket in one task, have buckets
of ``BUCKET_ROWS``.  Tables are registered in the session's catalog
under new names, with their files below the shared folder; nothing refers to
them once dropped (``drop``).
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions import month_of
from cohortlens.session import checkpoint_root
from cohortlens.sources.tables import Tables

MONTH = "usage_month"
BUCKET_ROWS = 1_000_000     # a bucket is one task's: sums per subscription, day and feature of these in memory
LEAST_BUCKETS = 8
SPLITS = "spark.sql.files.maxPartitionBytes"
SPLIT_BYTES = 16 << 20      # of the files that a task of the reduction reads; row groups stay whole
USAGE_GRAIN = ("subscription_id", "usage_date", "feature_name")


def usage_cube(t: Tables) -> DataFrame:
    """Usage summed per (subscription, day, feature)."""
    return (t.pick("feature_usage", *USAGE_GRAIN, "usage_count", "error_count", "is_beta_feature")
            .groupBy(*USAGE_GRAIN)
            .agg(F.sum("usage_count").alias("usage_count"), F.sum("error_count").alias("error_count"),
                 F.bool_or("is_beta_feature").alias("is_beta_feature")))


def default_buckets(t: Tables) -> int:
    """Buckets of about ``BUCKET_ROWS`` usage rows, ``LEAST_BUCKETS`` at least: a
    month has a file in each, so their number follows the data."""
    rows = t.pick("feature_usage", "subscription_id").count()     # from the files' footers
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


@dataclass
class Layout:
    """Names of the two tables in the session's catalog, and the other inputs."""
    spark: SparkSession
    usage: str
    subscriptions: str
    rest: Tables
    buckets: int

    def tables(self) -> Tables:
        """The inputs, usage and subscriptions from the layout."""
        usage, subs = self.spark.table(self.usage), self.spark.table(self.subscriptions)
        return self.rest.with_(feature_usage=usage.drop(MONTH), subscriptions=subs)

    def in_months(self, first: dt.date, last: dt.date) -> Tables:
        """The inputs with the usage of the months from ``first`` to ``last`` only:
        whole partitions, no other file is opened."""
        usage = self.spark.table(self.usage).where(
            F.col(MONTH).between(F.lit(first.replace(day=1)), F.lit(last.replace(day=1)))).drop(MONTH)
        return self.rest.with_(feature_usage=usage, subscriptions=self.spark.table(self.subscriptions))

    def drop(self) -> None:
        """Take the tables out of the catalog and delete their files."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for name in (self.usage, self.subscriptions):
            where = self.spark.sql(f"describe formatted {name}").where("col_name = 'Location'").first().data_type
            self.spark.sql(f"drop table {name}")
            path = hadoop.Path(where)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _small_splits(spark: SparkSession):
    """Inside, files are read in splits of ``SPLIT_BYTES``."""
    before = spark.conf.get(SPLITS)
    spark.conf.set(SPLITS, str(SPLIT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(SPLITS, before)


def store(spark: SparkSession, t: Tables, buckets: int | None = None, root: str | None = None) -> Layout:
    buckets = buckets or default_buckets(t)
    base = root or os.path.join(checkpoint_root(spark), "layout")
    tag = uuid.uuid4().hex[:12]

    def write(df: DataFrame, name: str, partition_by: list[str]) -> str:
        table = f"{name}_{tag}"
        writer = (df.write.format("parquet").bucketBy(buckets, "subscription_id").sortBy("subscription_id")
                  .option("path", os.path.join(base, table)))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(table)
        return table

    usage = usage_cube(t).withColumn(MONTH, month_of(F.col("usage_date"))).repartition(buckets, "subscription_id")
    with _small_splits(spark):
        return Layout(spark, write(usage, "usage", [MONTH]),
                      write(t.subscriptions.repartition(buckets, "subscription_id"), "subscriptions", []), t, buckets)
