"""The accounts summary (J12) maintained incrementally, in versions.

``SummaryStore`` keeps the summary as Parquet in a fixed number of buckets of
account ids.  A refresh recomputes the accounts a change touched, and only
these, merges them into the buckets they lie in, and publishes a new version:
one small table that says for each bucket which folder holds it now.  Buckets
without a touched account keep their files.  A version is complete when its
table is; readers take the newest complete one, so a refresh that dies leaves
the former version in place and is simply run again.

What touches an account: a new or changed row of its own in any input
(``touched_by``).  The last usage date is global: when it moves, the accounts
whose values depend on it - never churned, or with a subscription that runs to
the end of the data - are touched as well; the store knows them by the column
``open_ended``.  Values are those of a full run over the same inputs.

Scale: touched accounts restrict every input by a semi-join before anything is
aggregated; the rest is the work of ``accounts_summary`` on that part.  Merging
rewrites the buckets concerned.  With 4,096 buckets of 10^9 accounts, a refresh
that touches one account rewrites a 4,096th of the summary.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from cohortlens.operators import accounts as acc
from cohortlens.sources.tables import Tables

BUCKETS = 64
WHOLE = -1    # bucket number of the row about the whole version


def _last_use(t: Tables):
    return t.pick("feature_usage", "usage_date").agg(F.max("usage_date")).first()[0]


def touched_by(t: Tables, **appended: DataFrame) -> DataFrame:
    """account_id of the accounts that ``appended`` rows of inputs (by name, as in
    ``Tables``) belong to, once each; ``t``: the inputs with them."""
    out = None
    for name, rows in appended.items():
        if name == "feature_usage":
            rows = t.pick("subscriptions", "subscription_id", "account_id").join(
                rows.select("subscription_id").distinct(), "subscription_id", "left_semi")
        ids = rows.select("account_id").where("account_id is not null")
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()


def restricted(t: Tables, touched: DataFrame) -> Tables:
    """The inputs' rows of the touched accounts."""
    mine = lambda df: df.join(touched, "account_id", "left_semi")
    subs = mine(t.subscriptions)
    return Tables(mine(t.accounts), subs,
                  t.feature_usage.join(subs.select("subscription_id"), "subscription_id", "left_semi"),
                  mine(t.support_tickets), mine(t.churn_events))


class SummaryStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def _path(self, *parts):
        return os.path.join(self.root, *map(str, parts))

    def versions(self) -> list[int]:
        """Numbers of the complete versions."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self._path("versions"))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)
                      if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))

    def _manifest(self, version: int) -> tuple[dict[int, int], Row]:
        """(bucket -> version whose folder holds it, the row of the whole: last_use
        and the schema): at most one row per bucket is read."""
        rows = self.spark.read.parquet(self._path("versions", version)).collect()
        whole, = [r for r in rows if r.bucket == WHOLE]
        return {r.bucket: r.held_by for r in rows if r.bucket != WHOLE}, whole

    def _rows(self, held: dict[int, int], whole: Row) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(whole.schema))
        if not held:
            return self.spark.createDataFrame([], schema)
        paths = [self._path("rows", f"v={v}", f"bucket={b}") for b, v in sorted(held.items())]
        return self.spark.read.schema(schema).option("basePath", self._path("rows")).parquet(*paths)

    def current(self, version: int | None = None) -> DataFrame:
        """The summary: of the newest complete version, or the one given."""
        version = self.versions()[-1] if version is None else version
        return self._rows(*self._manifest(version)).select(*acc.SUMMARY_COLUMNS)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("account_id"), F.lit(self.buckets)).cast("int"))

    def _publish(self, version: int, held: dict[int, int], last_use, schema: str) -> None:
        rows = [(b, v, None, None) for b, v in sorted(held.items())] + [(WHOLE, version, last_use, schema)]
        (self.spark.createDataFrame(rows, "bucket int, held_by long, last_use date, schema string").coalesce(1)
         .write.mode("overwrite").parquet(self._path("versions", version)))

    def _write(self, df: DataFrame, version: int) -> list[int]:
        """Write bucketed rows; the buckets that have any."""
        path = self._path("rows", f"v={version}")
        df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(path)
        listed = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        return [int(s.getPath().getName().split("=")[1]) for s in listed if s.getPath().getName().startswith("bucket=")]

    def create(self, t: Tables) -> int:
        """The first version: a full run."""
        last_use = _last_use(t)
        full = self._bucketed(acc.accounts_summary(t, max_date=F.lit(last_use).cast("date"), open_ended=True))
        written = self._write(full, 0)
        self._publish(0, {b: 0 for b in written}, last_use, full.schema.json())
        return 0

    def refresh(self, t: Tables, touched: DataFrame) -> int:
        """The next version, with the ``touched`` accounts (account_id) recomputed
        from ``t``; accounts no longer in it go.  No touched account: no new version."""
        newest = self.versions()[-1]
        (held, whole), version = self._manifest(newest), newest + 1
        last_use = _last_use(t)
        if last_use != whole.last_use:
            touched = touched.unionByName(self._rows(held, whole).where("open_ended").select("account_id")).distinct()
        hit = {r.bucket for r in self._bucketed(touched).select("bucket").distinct().collect()}   # at most ``buckets``
        if not hit:
            return newest
        again = self._bucketed(acc.accounts_summary(restricted(t, touched), max_date=F.lit(last_use).cast("date"),
                                                    open_ended=True))
        old = {b: v for b, v in held.items() if b in hit}
        again = again.unionByName(self._rows(old, whole).join(touched, "account_id", "left_anti").select(*again.columns))
        written = self._write(again, version)
        kept = {b: v for b, v in held.items() if b not in hit}
        self._publish(version, kept | {b: version for b in written}, last_use, whole.schema)
        return version

    def expire(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions and the row folders that
        none of these uses."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        versions = self.versions()
        kept = versions[-keep:]
        used = {(v, b) for k in kept for b, v in self._manifest(k)[0].items()}
        fs = hadoop.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v in versions[:-keep]:
            fs.delete(hadoop.Path(self._path("versions", v)), True)
        for v in versions:
            for b in range(self.buckets):
                if (v, b) not in used:
                    fs.delete(hadoop.Path(self._path("rows", f"v={v}", f"bucket={b}")), True)
