"""Session settings the library is tuned for.

The library never depends on the session time zone (all times are
TIMESTAMP_NTZ in UTC) and works with ANSI mode on.  ``build_session`` is a
convenience; with a non-local master it adds :data:`CLUSTER_CONF` (shuffle
and file sizing, tolerance of lost executors) wherever the submitted
configuration is silent.  A session of your own works just as well.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # many small log files: pack them into fewer, larger tasks
    "spark.sql.files.openCostInBytes": str(1 << 20),
}


# Extra defaults for a cluster session (hundreds of executors, ~100 TB of
# logs).  Applied only to keys the submitted configuration leaves unset.
CLUSTER_CONF = {
    # start with many shuffle partitions; AQE merges them to the advisory size,
    # and parallelismFirst=false makes it honour that size on a busy cluster
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    # executors may be lost at any time: migrate shuffle and cached blocks off
    # decommissioning executors, and retry tasks and stages more often
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.storage.decommission.rddBlocks.enabled": "true",
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
}


def _submitted_conf() -> dict[str, str]:
    """Settings already given to the JVM (``spark-submit``, ``spark-defaults.conf``).

    Empty when this process will start the JVM itself: reading a ``SparkConf``
    would start it early, before launch-time settings such as driver memory
    from the builder are known.
    """
    from pyspark import SparkContext
    if SparkContext._gateway is None and "PYSPARK_GATEWAY_PORT" not in os.environ:
        return {}
    return dict(SparkConf().getAll())


def session_settings(master: str | None = None, shuffle_partitions: int | None = None, conf: dict | None = None,
                     cluster: bool | None = None, submitted: dict | None = None) -> dict[str, str]:
    """The settings :func:`build_session` applies (see there)."""
    submitted = submitted or {}
    effective_master = master or submitted.get("spark.master", "local[*]")
    if cluster is None:
        cluster = not effective_master.startswith("local")
    settings = dict(DEFAULT_CONF)
    if cluster:
        settings.update({k: v for k, v in CLUSTER_CONF.items() if k not in submitted})
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    return settings


def build_session(master: str | None = None, app: str = "logsift", shuffle_partitions: int | None = None,
                  conf: dict | None = None, cluster: bool | None = None) -> SparkSession:
    """Session with the library defaults.

    ``cluster`` adds :data:`CLUSTER_CONF` for keys not set by ``spark-submit``
    or ``spark-defaults.conf``; by default it follows the master (anything but
    ``local``).  Explicit ``shuffle_partitions`` and ``conf`` always win.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in session_settings(master, shuffle_partitions, conf, cluster, _submitted_conf()).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local-mode session that names none (local runs, tests) gets a
    private temporary folder.  On a cluster a machine-local folder would not
    survive the loss of an executor, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or S3) for checkpointing")
    path = tempfile.mkdtemp(prefix="logsift-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, how: str | None = "persist") -> DataFrame:
    """Reuse ``df`` across several actions.

    ``persist`` caches (memory and disk; lost blocks are recomputed from
    lineage), ``checkpoint`` writes to the shared checkpoint folder and cuts
    lineage, ``table`` does so as Parquet, which later readers prune by column
    and filter, ``None`` leaves the plan as is.
    """
    if how is None:
        return df
    if how == "persist":
        return df.persist()
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "table":
        path = f"{checkpoint_dir(df.sparkSession)}/logsift-table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    raise ValueError(f"unknown materialization {how!r}")

