"""Incremental ingestion: new log files -> parsed Parquet, with Structured Streaming.

The same parse functions as the batch sources run on a streaming text source,
so a log directory that keeps receiving deliveries is parsed exactly once
per file (file-source bookkeeping and the sink commit log live in the
checkpoint).  The result is the parsed table that the batch analyses read.

The checkpoint defaults to ``<spark.checkpoint.dir>/logsift-ingest/<log_type>``,
the shared folder the cluster names; a session without one must pass
``checkpoint_location`` explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.bundle import TIME_COLUMN
from ..sources.cloudtrail import LINES_REGEX, parse_cloudtrail_docs, parse_cloudtrail_lines
from ..sources.files import FLOW_NAME_REGEX
from ..sources.s3 import parse_s3_lines
from ..sources.vpc import parse_vpc_lines

_JSON_DOCS = r"(?i:\.(json|json\.gz)$)"


def _text_stream(spark: SparkSession, path: str, name_regex: str, wholetext: bool,
                 max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true").option("wholetext", wholetext)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(path)
    return (raw.filter(F.col("_metadata.file_name").rlike(name_regex))
               .select(F.col("value"), F.col("_metadata.file_name").alias("source_file")))


def stream_parsed(spark: SparkSession, path: str, log_type: str,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of parsed records for ``log_type`` (``cloudtrail``, ``vpc``, ``s3``)."""
    if log_type == "vpc":
        return parse_vpc_lines(_text_stream(spark, path, FLOW_NAME_REGEX, False, max_files_per_trigger))
    if log_type == "s3":
        return parse_s3_lines(_text_stream(spark, path, FLOW_NAME_REGEX, False, max_files_per_trigger))
    if log_type == "cloudtrail":
        docs = parse_cloudtrail_docs(_text_stream(spark, path, _JSON_DOCS, True, max_files_per_trigger))
        lines = parse_cloudtrail_lines(_text_stream(spark, path, LINES_REGEX, False, max_files_per_trigger))
        return docs.unionByName(lines)
    raise ValueError(f"unknown log type {log_type!r}")


def default_checkpoint(spark: SparkSession, log_type: str) -> str:
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("no spark.checkpoint.dir in this session: pass checkpoint_location")
    return f"{base.rstrip('/')}/logsift-ingest/{log_type}"


def ingest(spark: SparkSession, path: str, log_type: str, output_path: str,
           checkpoint_location: str | None = None, available_now: bool = True,
           processing_time: str | None = None, max_files_per_trigger: int | None = None,
           writers: int | None = None) -> StreamingQuery:
    """Start a query that appends newly delivered files of ``path`` to ``output_path``.

    Output is Parquet partitioned by event date, like ``plans.bundle.write_parsed``.
    ``available_now=True`` processes everything present and stops (batch-style
    catch-up, restartable); otherwise it runs every ``processing_time``.
    ``writers`` bounds the files of a batch to that many per date: rows are dealt
    by date and source file, so a busy date still spreads over tasks.
    """
    parsed = stream_parsed(spark, path, log_type, max_files_per_trigger)
    dated = parsed.withColumn("event_date", F.to_date(TIME_COLUMN[log_type]))
    if writers:
        deal = F.pmod(F.xxhash64("source_file"), F.lit(writers))
        dated = dated.repartition(writers, "event_date", deal).sortWithinPartitions("event_date")
    writer = (dated.writeStream.format("parquet").outputMode("append").partitionBy("event_date")
              .option("checkpointLocation", checkpoint_location or default_checkpoint(spark, log_type)))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start(output_path)
