"""Monthly active users (J15) as a stream with keyed state.

Usage is joined to its account and the account's activity bounds, then
``transformWithState`` keeps, per account, the set of months already counted in
the state store (RocksDB, checkpointed with the stream's offsets) and emits a
pair (account, month) once, when it is new.  A sink adds each batch's new pairs
per month to the counts before and publishes them as a version of their own.

A batch costs what its rows cost: state is looked up by key, and the sink reads
one earlier version (a row per month) and deletes versions no reader needs any
more (``KEPT_VERSIONS``).  Nothing grows with the number of batches; state is
bounded by accounts x months.

Every call to the state store is a round trip of the Python worker.  So an
account's months are one value, read once and written at most once per batch,
and an account's rows become one row with its months before they reach it
(``_months_per_account``, in parts of at most ``HELD_PAIRS``, after a shuffle by
account).  Months are numbers there: 12 x year + month - 1.

An account with a third of a batch's rows is one key.  So pairs are made unique
inside the tasks that read the usage (``_once_per_task``), before they are
shuffled: at most one row per month and Arrow batch reaches its task.

Exactly once: the state commits with the batch.  A batch run again after a
failure restores the state before it, emits the same pairs, and overwrites its
own version; it adds to the newest version below its number.

No usage is too late.  Subscriptions and bounds are those of the time the stream
was started (a static side); restart it to see new ones.  Rows with a NULL date
or without an account count nowhere.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cohortlens.functions import month_of
from cohortlens.operators.activity import account_activity_bounds
from cohortlens.operators.skew import lookup_join
from cohortlens.session import python_path
from cohortlens.sources.tables import Tables

KEPT_VERSIONS = 3
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
COUNTS = "active_month date, mau bigint"
HELD_PAIRS = 2_000_000    # of a task, before they go on as lists
LISTED_ROWS = 10_000      # accounts of an Arrow batch


class NewMonths(StatefulProcessor):
    """Per account: the months counted so far; emits the new ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._months = handle.getValueState("months", "months array<int>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._months.get()
        seen = set(held[0]) if held else set()
        new = {month for row in rows for month in row.active_months} - seen
        if new:
            self._months.update((sorted(seen | new),))
            yield Row(account_id=key[0], active_months=sorted(new))

    def close(self) -> None:
        pass


def _once_per_task(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from table.group_by(["account_id", "active_month"]).aggregate([]).select(batch.schema.names).to_batches()

    return pairs.mapInArrow(run, pairs.schema)


def _months_per_account(pairs: DataFrame) -> DataFrame:
    """(account_id, active_months): one row per account and part of a task."""
    names = pairs.columns

    def run(batches):
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= HELD_PAIRS:
                held = [pa.concat_tables(held).group_by(names).aggregate([]).select(names)]
                rows = held[0].num_rows
                if rows > HELD_PAIRS // 2:
                    yield from listed(held)
                    held, rows = [], 0
        if held:
            yield from listed(held)

    def listed(held):
        found = (pa.concat_tables(held).group_by("account_id").aggregate([("active_month", "distinct")])
                 .select(["account_id", "active_month_distinct"]).rename_columns(["account_id", "active_months"]))
        return found.combine_chunks().to_batches(max_chunksize=LISTED_ROWS)

    key = pairs.schema["account_id"].dataType.simpleString()
    return (pairs.select("account_id", (12 * F.year("active_month") + F.month("active_month") - 1).alias("active_month"))
            .mapInArrow(run, f"account_id {key}, active_months array<int>"))


def new_pairs(usage: DataFrame, t: Tables, partitions: int | None = None) -> DataFrame:
    """Stream of (account_id, active_month), each once, of streaming ``usage``."""
    subs = lookup_join(t.pick("subscriptions", "subscription_id", "account_id"),
                       account_activity_bounds(t), "account_id", "inner")
    d, until = F.col("usage_date"), F.col("active_until")
    pairs = (usage.select("subscription_id", "usage_date").join(subs, "subscription_id")
             .where((d >= F.col("signup_date")) & (until.isNull() | (d <= until)))
             .select("account_id", month_of(d).alias("active_month")))
    spread = [partitions] if partitions else []
    months = _months_per_account(_once_per_task(pairs).repartition(*spread, "account_id"))
    return (months.groupBy("account_id").transformWithState(NewMonths(), months.schema, "Append", "None")
            .select("account_id", F.explode("active_months").alias("_month"))
            .select("account_id", F.expr("make_date(_month div 12, _month % 12 + 1, 1)").alias("active_month")))


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(root, "mau"))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions: at most KEPT_VERSIONS and one that is being written."""
    fs, path = _folder(spark, root)
    if not fs.exists(path):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)
                  if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The published counts: the newest complete version."""
    versions = _versions(spark, root)
    if not versions:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(os.path.join(root, "mau", str(versions[-1])))


def publish(pairs: DataFrame, batch_id: int, root: str) -> None:
    """Add a batch's new pairs to the counts before it."""
    spark = pairs.sparkSession
    counts = pairs.groupBy("active_month").agg(F.count(F.lit(1)).alias("mau"))
    versions = _versions(spark, root)
    older = [v for v in versions if v < batch_id]
    if older:
        before = spark.read.schema(COUNTS).parquet(os.path.join(root, "mau", str(older[-1])))
        counts = counts.unionByName(before).groupBy("active_month").agg(F.sum("mau").alias("mau"))
    # shuffled, not coalesced: one task would hold the aggregates of all partitions
    counts.repartition(1).write.mode("overwrite").parquet(os.path.join(root, "mau", str(batch_id)))
    fs, path = _folder(spark, root)
    for version in older[:-(KEPT_VERSIONS - 1)]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, str(version)), True)


def start(usage: DataFrame, t: Tables, root: str, available_now: bool = True,
          state_partitions: int | None = None) -> StreamingQuery:
    """Run the stream over streaming ``usage``; ``root``, on the shared file
    system, holds the checkpoint with its state and the published counts.
    ``state_partitions`` (the session's shuffle partitions unless given) is fixed
    by the first start below ``root``."""
    spark = usage.sparkSession
    python_path(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    before = spark.conf.get(PARTITIONS)
    if state_partitions:
        spark.conf.set(PARTITIONS, str(state_partitions))     # the query keeps the settings it starts with
    try:
        return _writer(usage, t, root, available_now, state_partitions).start()
    finally:
        spark.conf.set(PARTITIONS, before)


def _writer(usage: DataFrame, t: Tables, root: str, available_now: bool, partitions: int | None = None):
    writer = (new_pairs(usage, t, partitions).writeStream.outputMode("append")
              .foreachBatch(lambda pairs, batch_id: publish(pairs, batch_id, root))
              .option("checkpointLocation", os.path.join(root, "checkpoint")))
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
