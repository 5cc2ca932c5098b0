"""Session helpers.

Library code never creates a session; callers pass one in.  ``local_session``
is for tests and the bench only.  ``checkpoint_root`` reads the cluster's
``spark.checkpoint.dir`` and only sets one when it is unset (tests).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for every job here: adaptive execution re-plans joins
# and coalesces partitions from runtime sizes, and splits skewed join
# partitions; the UI stays off (no server).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # without it, every Column call looks up the session, its settings and the
    # Python stack over the gateway: most of the time a plan takes to build
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]")
               .appName("cohortlens")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised tables and streaming state.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system that
    survives executor loss).  Only when nothing is configured and the master
    is local, as in tests, a fresh folder is created and registered; on a
    cluster a missing setting is an error, never a machine-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server owns the context
        sc = None
    if sc is not None and not configured:
        configured = sc.getCheckpointDir()
    if configured:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
    local = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    if sc is not None:
        sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def python_path(spark: SparkSession) -> None:
    """This library's folder on the path of Python workers, for sessions started
    without it (a cluster gets it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def table_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_root(spark), "tables", name)


def cluster_conf(input_bytes: int, executor_cores: int = 4, executors: int = 1000,
                 shuffle_bytes: int | None = None) -> dict:
    """Settings for a run over ``input_bytes`` of Parquet on a cluster.

    * initial shuffle partitions: about 256 MB of shuffled data each and at
      least three waves of tasks.  ``shuffle_bytes`` is the largest shuffle's
      size; unless given, a twentieth of the input, as jobs shuffle a few
      pruned columns after map-side combination.  AQE coalesces and splits
      from there; many more partitions than needed are not free, as the driver
      tracks a block for each pair of map task and partition;
    * scan splits of 512 MB (row groups are never split further);
    * more task attempts and decommissioning, so lost executors (spot
      reclamation) re-run tasks instead of failing the job; shuffle files of
      a decommissioned executor are migrated before it goes;
    * Parquet through the DataSource V2 reader with aggregate pushdown: on
      stored, typed tables the last usage date (``max``) and the row counts
      of the skew check are answered from Parquet footers, without reading
      data pages.
    """
    slots = executor_cores * executors
    shuffle_bytes = input_bytes // 20 if shuffle_bytes is None else shuffle_bytes
    partitions = max(3 * slots, int(shuffle_bytes // (256 << 20)))
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
        "spark.sql.files.maxPartitionBytes": "512m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.task.maxFailures": "8",
        "spark.stage.maxConsecutiveAttempts": "8",
        "spark.decommission.enabled": "true",
        "spark.storage.decommission.enabled": "true",
        "spark.storage.decommission.shuffleBlocks.enabled": "true",
        "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
        "spark.sql.parquet.aggregatePushdown": "true",
    }
