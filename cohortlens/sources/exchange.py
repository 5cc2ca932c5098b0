"""Results as CSV files that others write and read: checked load, committed
export, preview (J36).

``export`` writes a result as CSV with a header into a new folder and makes it
visible by one more file, written last: the commit, which names the files with
their sizes and the number of rows.  A reader never sees half an export, and an
export that dies leaves the one before.  ``load`` takes the newest commit,
checks that the files are those it names, and reads them with the declared
schema, never inferred; the header's names must be the schema's.  Lines that
don't fit the schema don't fail the load and don't vanish: they come back apart,
whole, with their file.

Spark writes and reads the files in parallel; the driver handles file names
only.  Dates are ISO, a missing value is an empty field, an empty text a quoted
one.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

BAD_LINE = "_bad_line"
CSV = {"header": "true", "quote": '"', "escape": '"', "dateFormat": "yyyy-MM-dd", "nullValue": "", "emptyValue": '""',
       "quoteAll": "false", "lineSep": "\n"}


class IncompleteExport(RuntimeError):
    """The files are not those that the commit names."""


@dataclass
class Loaded:
    """``rows``: typed, those that fit the schema; ``rejected``: the lines that
    don't (``_bad_line``, ``file``); ``expected``: rows the commit states, if any."""
    rows: DataFrame
    rejected: DataFrame
    expected: int | None


def _fs(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    fs, path = _fs(spark, folder)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(path)
            if s.getPath().getName().startswith("part-")}


def _commits(spark: SparkSession, root: str) -> list[str]:
    fs, path = _fs(spark, os.path.join(root, "_commits"))
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def export(df: DataFrame, root: str) -> str:
    """Write ``df`` as the next version below ``root``; its folder.  Its rows are
    counted while they are written."""
    spark = df.sparkSession
    version = len(_commits(spark, root))
    folder = os.path.join(root, f"v{version}-{uuid.uuid4().hex[:8]}")
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.options(**CSV).csv(folder)
    commit = json.dumps({"folder": os.path.basename(folder), "files": _files(spark, folder),
                         "rows": counted.get["rows"], "columns": df.columns})
    fs, path = _fs(spark, os.path.join(root, "_commits", f"{version:08d}"))
    out = fs.create(path, False)           # fails where another export was committed meanwhile
    try:
        out.write(bytearray(commit.encode()))
    finally:
        out.close()
    return folder


def _commit(spark: SparkSession, root: str, name: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(os.path.join(root, "_commits", name), wholetext=True).collect()))


def read_checked(spark: SparkSession, path, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected lines) of CSV files.  A line is rejected when a field
    can't be read as its type or the number of fields isn't the schema's."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_bad = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    lines = (spark.read.schema(with_bad).options(**{**CSV, "emptyValue": ""})
             .option("mode", "PERMISSIVE").option("enforceSchema", "false")
             .option("columnNameOfCorruptRecord", BAD_LINE).csv(path))
    # a line is checked for the columns that are read of it: this always reads all
    read_all = F.length(F.concat_ws("", *[F.col(f.name).cast("string") for f in schema.fields])) >= 0
    rows = lines.where(read_all & F.col(BAD_LINE).isNull()).drop(BAD_LINE)
    rejected = (lines.withColumn("file", F.input_file_name()).where(read_all & F.col(BAD_LINE).isNotNull())
                .select(BAD_LINE, "file"))
    return rows, rejected


def load(spark: SparkSession, root: str, schema: T.StructType | str) -> Loaded:
    """The newest committed export below ``root``."""
    commits = _commits(spark, root)
    if not commits:
        raise IncompleteExport(f"no committed export below {root}")
    commit = _commit(spark, root, commits[-1])
    folder = os.path.join(root, commit["folder"])
    if _files(spark, folder) != commit["files"]:
        raise IncompleteExport(f"the files of {folder} are not those of its commit")
    return Loaded(*read_checked(spark, folder, schema), commit["rows"])


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows: in the order given, or of the files."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)
