"""Monthly active users (J15) maintained incrementally with Structured
Streaming, for feature usage that keeps arriving as files.

Every micro-batch runs the same lazy step on its rows: usage is joined to the
subscriptions and the accounts' activity bounds as they are *now* (``load`` is
called anew for each batch, so files that landed meanwhile are read), reduced
to distinct (account, month) pairs, and freed of the pairs known already.  The
new pairs are appended as one more part of the state, and the published counts
become the previous ones plus the new ones.  No row is ever too late: a pair
of any month is added when its usage arrives.

Fault tolerance: offsets live in the stream's checkpoint; state and counts
under a folder per batch number.  A batch that is run again after a failure
overwrites its own folders and reads only older ones, so it counts once.
Readers use ``current``, which takes the newest complete version: a published
table is never overwritten in place.

State is bounded by accounts x months.  A subscription or churn date that
changes after its usage was processed does not change pairs counted before.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortlens.functions import month_of
from cohortlens.operators.activity import account_activity_bounds
from cohortlens.operators.skew import lookup_join
from cohortlens.sources.tables import DRIVER_SCHEMAS, Tables, map_feature_usage

def usage_stream_from_driver_files(spark: SparkSession, path: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Stream of feature usage rows from driver ``lineitem`` Parquet files:
    ``path`` is a directory new files land in, or a glob over files."""
    raw = (spark.readStream.schema(DRIVER_SCHEMAS["lineitem"])
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))
    return map_feature_usage(raw)


def active_pairs(usage: DataFrame, t: Tables) -> DataFrame:
    """Distinct (account_id, active_month) of the usage rows that count."""
    days = usage.select("subscription_id", "usage_date").distinct()
    subs = lookup_join(t.subscriptions.select("subscription_id", "account_id"),
                       account_activity_bounds(t), "account_id", "inner")
    d, until = F.col("usage_date"), F.col("active_until")
    return (days.join(subs, "subscription_id")
            .where((d >= F.col("signup_date")) & (until.isNull() | (d <= until)))
            .select("account_id", month_of(d).alias("active_month")).distinct())


def monthly_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("active_month").agg(F.count(F.lit(1)).alias("mau"))


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions below ``folder``, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The published counts (active_month, mau): the newest complete version."""
    versions = _versions(spark, os.path.join(root, "mau"))
    if not versions:
        return spark.createDataFrame([], "active_month date, mau bigint")
    return spark.read.parquet(os.path.join(root, "mau", str(versions[-1])))


def process(batch: DataFrame, batch_id: int, load: Callable[[SparkSession], Tables], root: str) -> None:
    """One micro-batch: append its new pairs, publish the next version."""
    spark = batch.sparkSession
    pairs = active_pairs(batch, load(spark))
    parts = [os.path.join(root, "pairs", str(v)) for v in _versions(spark, os.path.join(root, "pairs")) if v < batch_id]
    if parts:
        pairs = pairs.join(spark.read.parquet(*parts), ["account_id", "active_month"], "left_anti")
    new_part = os.path.join(root, "pairs", str(batch_id))
    pairs.write.mode("overwrite").parquet(new_part)
    counts = monthly_counts(spark.read.schema(pairs.schema).parquet(new_part))
    older = [v for v in _versions(spark, os.path.join(root, "mau")) if v < batch_id]
    if older:
        counts = counts.unionByName(spark.read.parquet(os.path.join(root, "mau", str(older[-1])))) \
            .groupBy("active_month").agg(F.sum("mau").alias("mau"))
    counts.write.mode("overwrite").parquet(os.path.join(root, "mau", str(batch_id)))


def start(usage: DataFrame, load: Callable[[SparkSession], Tables], root: str, checkpoint: str | None = None,
          available_now: bool = True) -> StreamingQuery:
    """Run the stream over ``usage`` (streaming feature usage); ``root`` holds
    state and published counts, on the shared file system."""
    writer = (usage.writeStream.foreachBatch(lambda batch, batch_id: process(batch, batch_id, load, root))
              .option("checkpointLocation", checkpoint or os.path.join(root, "checkpoint")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
