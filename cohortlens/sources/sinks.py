"""Writing results and cutting lineage.

``materialize`` writes a DataFrame as Parquet under the cluster's shared
checkpoint folder (``spark.checkpoint.dir``) and returns a DataFrame that
reads it back: later jobs start from the written files instead of
re-running the whole lineage, and a lost executor costs at most the tasks of
the current stage.  Reading back Parquet (rather than ``checkpoint()``'s row
files) keeps column pruning and filter pushdown for every consumer.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from cohortlens.session import checkpoint_root


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None,
                root: str | None = None) -> DataFrame:
    spark = df.sparkSession
    base = root or os.path.join(checkpoint_root(spark), "tables")
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Sink for a job result: Parquet by default; CSV with a header, as the
    source published its results."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
