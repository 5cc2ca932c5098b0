"""Helpers the training-data operators share.

Nothing here collects data.  ``stored`` cuts lineage with a written Parquet
table in the folder ``spark.checkpoint.dir`` names (shared by driver and
executors), so a lost executor costs only the running stage.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.session import checkpoint_root

#: Rows of one Arrow batch handed to a Python worker.  Texts are passed whole
#: and some are very long, so Spark's default of 10,000 rows is no bound on
#: memory; 256 rows are.
BATCH_ROWS = 256

#: What a task writes of tables with a row for each document, and of tables of
#: a few numbers in each row: some 4 MB and 8 MB.
DOCS_PER_TASK = 2048
LINKS_PER_TASK = 1 << 18

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def python_workers(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ready the session for Arrow-fed Python: batches of at most ``rows`` rows
    (the setting is never raised), and this library's folder on the workers'
    path, for sessions started without it (clusters get it by --py-files)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name for one intermediate table in the shared folder."""
    return f"{checkpoint_root(spark)}/cohortlens-llm/{name}-{uuid.uuid4().hex[:16]}"


def stored(df: DataFrame, name: str, fmt: str = "parquet", partition_by: list[str] | None = None,
           **options) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def fitted(df: DataFrame, rows: int, rows_per_task: int) -> DataFrame:
    """``df``, which has about ``rows`` rows at most, in as many partitions as
    they ask for, two for each core at least, and never in more than it has.
    What is written then has files by its size, not by the session's shuffles."""
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, -(-rows // rows_per_task)))


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table ``stored`` made, once nothing reads it."""
    spark = df.sparkSession
    root = f"{checkpoint_root(spark)}/cohortlens-llm/"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    marker = root.rsplit("/", 2)[-2]
    for folder in {f[: f.index("/", f.index(marker) + len(marker) + 1)]
                   for f in df.inputFiles() if f"/{marker}/" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column of ``columns`` has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
