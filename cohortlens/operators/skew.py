"""Skew-safe joins of a large table to a per-key lookup table.

Joining subscriptions (large, possibly skewed: one account may own a third of
them) to a per-account table (one row per account) puts every row of a hot
account into one task of a shuffle join.  Adaptive skew splitting cannot help
where the lookup side arrives already partitioned by its own aggregation
(which is what saves its exchange), so hot keys are salted explicitly.  The
plan is the same at every size:

* a key is hot when it holds more than ``rows_per_task`` rows of the large
  table, so there are at most rows / ``rows_per_task`` hot keys: half a
  million for 10^12 rows.  This table (key, number of salts) is broadcast;
* each hot key gets ``ceil(rows / rows_per_task)`` salts; its rows in the
  large table take a deterministic salt in that range, and its one lookup
  row is replicated once per salt - at most one extra lookup row per
  ``rows_per_task`` rows of the large table plus one per hot key;
* the join runs on (key, salt), so a hot key is spread over as many tasks
  as its size needs.  Rows with a NULL key, which never match, are spread by
  a hash of the whole row, however many they are.

The extra cost is one partially aggregated count per key of the large table -
the size of one per-account aggregate.  A run of many jobs counts once and
hands the hot keys in (``Tables.hot_accounts``).  Nothing runs while the plan is
built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ROWS_PER_TASK = 2_000_000    # target rows of one hot key per join task


def hot_keys(big: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys of ``big`` holding more than ``rows_per_task`` of its rows, with
    their row counts (``_rows``)."""
    return (big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") > rows_per_task))


def lookup_join(big: DataFrame, lookup: DataFrame, key: str, how: str = "left",
                rows_per_task: int = ROWS_PER_TASK, hot: DataFrame | None = None) -> DataFrame:
    """``big.join(lookup, key, how)`` for a ``lookup`` with one row per key
    (``how`` is 'left' or 'inner'), safe for skew on ``key`` in ``big``.
    Output columns: ``big``'s, then ``lookup``'s other columns.  ``hot``: the
    result of ``hot_keys``, where a run has stored it; else it is counted here."""
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    values = [c for c in lookup.columns if c != key]
    salts = F.broadcast(  # <= rows / rows_per_task rows
        (hot_keys(big, key, rows_per_task) if hot is None else hot)
        .select(key, F.ceil(F.col("_rows") / F.lit(rows_per_task)).cast("int").alias("_salts")))
    whole = F.xxhash64(*big.columns)
    tagged = (big.join(salts, key, "left")
              .withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(whole, F.col("_salts").cast("long")))
                          .when(F.col(key).isNull(), whole).otherwise(F.lit(0).cast("long")))
              .drop("_salts"))
    replicated = (lookup.join(salts, key, "left")
                  .withColumn("_salt", F.explode(F.sequence(
                  F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)).cast("long") - 1)))
              .drop("_salts"))
    joined = tagged.join(replicated, [key, "_salt"], how)
    return joined.select(*[F.col(c) for c in big.columns], *[F.col(c) for c in values])
