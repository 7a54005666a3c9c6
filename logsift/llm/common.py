"""Helpers shared by the corpus operators: table access, staging, global positions, Arrow columns."""

from __future__ import annotations

import sys
import uuid
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.session import checkpoint_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILES_PER_CORE = 4
FILE_BYTES = 8 << 20


def files_for(source: DataFrame, per_core: int = FILES_PER_CORE) -> int:
    """How many files a table made from ``source`` may have: some per core, and one more for every ``FILE_BYTES`` of it."""
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(per_core * max(2, source.sparkSession.sparkContext.defaultParallelism), -(-size // FILE_BYTES))


def compact(df: DataFrame, files: int) -> DataFrame:
    """``df`` in at most ``files`` partitions, without a shuffle.

    Tiny partitions (a scan of many small files, a shuffle of little data) are
    merged, since a file costs more than the rows in it; with ``files_for`` of
    the input, partitions of ``FILE_BYTES`` of it or more stay as they are.
    """
    return df.coalesce(min(files, (1 << 31) - 1))


def stage(df: DataFrame, label: str, files: int) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but keeps column pruning and filters for
    later readers; survives lost executors because the folder is shared.  The
    write's shuffle files go when it is done, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        compact(df, files).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def unstage(df: DataFrame) -> None:
    """Remove the files of a frame that :func:`stage` returned and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(df: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """The ``most`` rows of ``df`` (of ``total``) with the smallest hash of ``key``; a threshold on
    the hash leaves about twice as many to sort."""
    mixed = F.xxhash64(F.xxhash64(key))
    if total > 4 * most:
        df = df.where(F.pmod(mixed, F.lit(1 << 32)) < (2 * most << 32) // total)
    return df.orderBy(F.pmod(mixed, F.lit(1 << 32)), key).limit(most)


def schema_with(df: DataFrame, **more) -> T.StructType:
    """The schema of ``df`` with fields (name=type) added."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


MANY_FILES = 1 << 16


def _one_scan(docs: DataFrame) -> bool:
    """Is ``docs`` a table read with nothing but deterministic projections and filters on it?"""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().head()
    return plan.children().size() == 0 and "Relation" in plan.nodeName()


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a long column ``name`` that tells its rows apart and is the same in every scan.

    A number that follows the split of a scan changes when executors come or go
    between two scans.  Rows of a table read are numbered by their file's place
    among the sorted paths and their place in the file; any other frame, or one of
    more files than ``MANY_FILES`` (the bound of what is broadcast), is staged once
    with its numbers.
    """
    if _one_scan(docs):
        path, place = fresh(docs, "file_path"), fresh(docs, "file_row")
        try:
            placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
        except AnalysisException:                     # a source without places
            placed = None
        found = [] if placed is None else sorted(r[0] for r in placed.select(path).distinct().limit(MANY_FILES + 1).collect())
        if placed is not None and len(found) <= MANY_FILES:
            files = docs.sparkSession.createDataFrame([(p, i << 40) for i, p in enumerate(found)], f"{path} string, {name} long")
            joined = placed.join(F.broadcast(files), path)
            return joined.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(name) + F.col(place)).alias(name))
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", files_for(docs))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def global_order(df: DataFrame, keys: list, label: str) -> tuple[DataFrame, str, int]:
    """Range-sort ``df`` by ``keys`` and number its rows from 0 in that order.

    Returns the staged frame with the global position, the name of that column
    (long; not one of ``df``'s) and the number of rows.  Spark samples the
    splitters; each partition is numbered locally and shifted by the row counts
    of the partitions before it (one row per partition reaches one task).
    """
    pid, local, pos = fresh(df, "range_id"), fresh(df, "range_pos"), fresh(df, "pos")
    n = partitions(df.sparkSession)
    sorted_ = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(pid, F.spark_partition_id())

    def number(batches):
        at = 0
        for b in batches:
            yield b.append_column(local, pa.array(np.arange(at, at + b.num_rows, dtype=np.int64)))
            at += b.num_rows

    staged = stage(sorted_.mapInArrow(number, schema_with(sorted_, **{local: "long"})), label, files_for(df))
    start = fresh(staged, "range_start")
    sizes = staged.groupBy(pid).agg(F.count(F.lit(1)).alias(start))
    before = sizes.select(pid, (F.sum(start).over(Window.orderBy(pid)) - F.col(start)).alias(start))
    # one row per range partition: at most spark.sql.shuffle.partitions rows
    out = staged.join(F.broadcast(before), pid)
    return out.select(*df.columns, (F.col(start) + F.col(local)).alias(pos)), pos, staged.count()


def per_worker(key: str, make, version: str = ""):
    """``make()``, called once by a Python worker and shared by its tasks; another ``version`` takes its place."""
    held = sys.modules.setdefault("_logsift_per_worker", ModuleType("_logsift_per_worker")).__dict__
    if key not in held or held[key][0] != version:
        held.pop(key, None)
        held[key] = (version, make())
    return held[key][1]


def raw(column: pa.Array) -> list[bytes]:
    """The values of a string or binary Arrow column as UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(kind)
    return [v or b"" for v in column.to_pylist()]
