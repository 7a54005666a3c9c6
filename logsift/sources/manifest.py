"""A manifest of delivered log files: what is there, from which day, account and region, and what was read already.

A log archive has millions of small files.  Reading a directory lists the whole
tree on the driver every time, and opens what a date filter then drops.  The
manifest is a table of files (a row each, partitioned by delivery date) that is kept
by increments: ``update_manifest`` lists the folders of the given days only and
replaces those days.  A reader picks files by date, account and region before any of
them is listed or opened, and ``new_files`` leaves out what an earlier run has read.

Gzip files can't be split, so how they are dealt to tasks decides how long the slowest
takes.  ``read_files`` deals them by estimated plain size, longest first to the least
loaded task; their compressed bytes move once, then each task unpacks its own.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from collections.abc import Iterable
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cloudtrail import BY_LINE, LINES_REGEX, is_large, large_line_files, parse_cloudtrail_docs, parse_cloudtrail_lines
from .files import CLOUDTRAIL_NAME_REGEX, FLOW_NAME_REGEX, read_text_files
from .s3 import parse_s3_lines
from .vpc import parse_vpc_lines

SCHEMA = "path string, name string, bytes bigint, modified timestamp, account string, region string, gzip boolean, delivery_date date"
NAME_REGEX = {"cloudtrail": CLOUDTRAIL_NAME_REGEX, "vpc": FLOW_NAME_REGEX, "s3": r"^"}
UNPACKED = 10             # how many times its size a gzip file of logs holds, about
TASK_BYTES = 256 << 20    # plain bytes of the gzip files of one task, about
MOST_BYTES = 1 << 30      # a larger file is left to the text source, which streams it
_READ = 1 << 20
# functions that run in tasks travel by value, so executors need no installed copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def delivery_date(path: Column, name: Column) -> Column:
    """The day of ``.../yyyy/mm/dd/...``, else of a name that begins with ``yyyy-mm-dd``, else NULL."""
    folder = F.regexp_extract(path, r"/(\d{4})/(\d{2})/(\d{2})/[^/]*$", 0)
    day = F.when(folder != "", F.concat_ws("-", *[F.regexp_extract(folder, r"/(\d{4})/(\d{2})/(\d{2})/", i) for i in (1, 2, 3)]))
    return F.coalesce(day, F.nullif(F.regexp_extract(name, r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))).try_cast("date")


def _listed(spark: SparkSession, paths: list[str], log_type: str) -> DataFrame:
    """The files under ``paths`` with what their paths tell; no file is opened (no content is selected)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    name = F.col("_metadata.file_name")
    files = files.where(name.rlike(NAME_REGEX[log_type])).select("path", name.alias("name"), F.col("length").alias("bytes"),
                                                                 F.col("modificationTime").alias("modified"))
    owner = F.regexp_extract("path", r"/(\d{12})/[^/]+/([a-z0-9-]+)/\d{4}/\d{2}/\d{2}/", 0)
    part = lambda i: F.nullif(F.regexp_extract(owner, r"/(\d{12})/[^/]+/([a-z0-9-]+)/", i), F.lit(""))
    return files.select("path", "name", "bytes", "modified", part(1).alias("account"), part(2).alias("region"),
                        F.lower("name").endswith(".gz").alias("gzip"), delivery_date(F.col("path"), F.col("name")).alias("delivery_date"))


def day_folders(spark: SparkSession, root: str, days: Iterable[str], depth: int = 6) -> list[str]:
    """The folders ``yyyy/mm/dd`` of the days under ``root``, up to ``depth`` levels down (organisation, account,
    service and region come before the date).  Only folders on the way are listed."""
    jvm, found = spark._jvm, []
    for day in days:
        tail = "/".join(day.split("-"))
        for level in range(depth + 1):
            pattern = jvm.org.apache.hadoop.fs.Path("/".join([root.rstrip("/"), *["*"] * level, tail]))
            hits = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
            found += [h.getPath().toString() for h in hits or [] if h.isDirectory()]
    return found


def update_manifest(spark: SparkSession, root: str, manifest: str, log_type: str, days: Iterable[str] | None = None) -> None:
    """List the days (``yyyy-MM-dd``; default: everything) under ``root`` and put them into the manifest table,
    replacing what it had of them; a day that has no files any more is emptied."""
    days = None if days is None else list(days)
    paths = [root] if days is None else day_folders(spark, root, days)
    listed = _listed(spark, paths, log_type) if paths else spark.createDataFrame([], SCHEMA)
    if days is not None:
        # a row without a path keeps the partition of a day, so that one without files replaces what was there
        marks = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("delivery_date"))
        listed = listed.unionByName(marks, allowMissingColumns=True)
    (listed.repartition("delivery_date").write.mode("overwrite").option("partitionOverwriteMode", "static" if days is None else "dynamic")
     .partitionBy("delivery_date").parquet(manifest))


def manifest_files(spark: SparkSession, manifest: str, first_day: str | None = None, last_day: str | None = None,
                   accounts: Iterable[str] | None = None, regions: Iterable[str] | None = None) -> DataFrame:
    """Files of the manifest by day (partitions pruned), account and region."""
    files = spark.read.schema(SCHEMA).parquet(manifest).where("path is not null")
    if first_day is not None:
        files = files.where(F.col("delivery_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        files = files.where(F.col("delivery_date") <= F.lit(last_day).cast("date"))
    if accounts is not None:
        files = files.where(F.col("account").isin(list(accounts)))
    if regions is not None:
        files = files.where(F.col("region").isin(list(regions)))
    return files


def new_files(files: DataFrame, done: str) -> DataFrame:
    """Those of ``files`` that the table ``done`` doesn't have, or has with another size or time (delivered anew)."""
    try:
        known = files.sparkSession.read.schema(SCHEMA).parquet(done).select("path", "bytes", "modified")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return files
    return files.join(known, ["path", "bytes", "modified"], "left_anti").select(*files.columns)


def mark_done(files: DataFrame, done: str) -> None:
    """Add files to the table ``done``, after what was read of them has been written."""
    files.write.mode("append").parquet(done)


def deal(sizes: list[tuple[str, int]], tasks: int) -> dict[str, int]:
    """path -> task: longest first, each to the task that has the least so far."""
    load = [(0, i) for i in range(tasks)]
    out = {}
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        held, task = heapq.heappop(load)
        out[path] = task
        heapq.heappush(load, (held + size, task))
    return out


def _unpacked(content: bytes, ignore_corrupt: bool):
    """The plain bytes of a gzip file (of several members, too), piece by piece."""
    data, at = zlib.decompressobj(31), 0
    view = memoryview(content)
    try:
        while at < len(view):
            piece = view[at:at + _READ]
            at += len(piece)
            while piece:
                yield data.decompress(piece)
                piece = data.unused_data
                if data.eof and piece:
                    data = zlib.decompressobj(31)
                elif not data.eof:
                    piece = b""
        if not data.eof:
            raise EOFError("a gzip file ends before its data does")
    except (zlib.error, EOFError):
        if not ignore_corrupt:
            raise


def lines_of(pieces):
    """Lines as the text source splits them: at CR, LF or both."""
    rest = b""
    for piece in pieces:
        rest += piece
        if rest.endswith(b"\r"):
            cut = len(rest) - 1                         # the line feed may be in the next piece
        else:
            cut = len(rest)
        lines = rest[:cut].splitlines(keepends=True)
        if lines and not lines[-1].endswith((b"\n", b"\r")):
            cut -= len(lines.pop())
        for line in lines:
            yield line.rstrip(b"\r\n") if line.endswith(b"\r\n") else line[:-1]
        rest = rest[cut:]
    if rest:
        yield rest[:-1] if rest.endswith(b"\r") else rest


def read_packed(spark: SparkSession, sizes: list[tuple[str, int]], wholetext: bool, ignore_corrupt: bool = False) -> DataFrame:
    """``(value, source_file)`` of gzip files, dealt to tasks by size."""
    total = sum(size for _, size in sizes) * UNPACKED
    tasks = min(len(sizes), max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))
    placed = spark.createDataFrame(list(deal(sizes, tasks).items()), "path string, task int")
    raw = spark.read.format("binaryFile").load([p for p, _ in sizes]).select("path", F.col("_metadata.file_name").alias("source_file"), "content")
    # a row per chosen file, as the list of paths on the driver
    dealt = raw.join(F.broadcast(placed), "path").repartitionById(tasks, F.col("task")).select("source_file", "content")

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("source_file").to_pylist(), b.column("content")):
                pieces = _unpacked(content.as_buffer().to_pybytes() if content.is_valid else b"", ignore_corrupt)
                if wholetext:
                    yield pa.record_batch([pa.array([b"".join(pieces).decode("utf-8", "replace")]), pa.array([name])], names=["value", "source_file"])
                    continue
                held, size = [], 0
                for line in lines_of(pieces):
                    held.append(line.decode("utf-8", "replace"))
                    size += len(line)
                    if size > _READ:
                        yield pa.record_batch([pa.array(held), pa.array([name] * len(held))], names=["value", "source_file"])
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(held, pa.string()), pa.array([name] * len(held))], names=["value", "source_file"])

    return dealt.mapInArrow(run, "value string, source_file string")


def read_files(spark: SparkSession, files: DataFrame, wholetext: bool = False, ignore_corrupt: bool = False) -> DataFrame | None:
    """``(value, source_file)`` of the files of a manifest selection; None if there are none.

    The paths of the selection come to the driver, as those of any list of files to read.
    """
    chosen = [(r.path, r.bytes, r.gzip) for r in files.select("path", "bytes", "gzip").collect()]
    packed = [(p, n) for p, n, gzip in chosen if gzip and n <= MOST_BYTES]
    own = {p for p, _ in packed}
    plain = [p for p, _, _ in chosen if p not in own]
    parts = [read_packed(spark, packed, wholetext, ignore_corrupt)] if packed else []
    if plain:
        parts.append(read_text_files(spark, plain, r"^", wholetext, ignore_corrupt))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _plain_path(uri: str) -> str:
    """The path as a listing has it, of a file's URI."""
    return re.sub(r"^([\w+.-]+):/{2,}(?=/)", r"\1:", unquote(uri))


def read_manifest(spark: SparkSession, files: DataFrame, log_type: str, ignore_corrupt: bool = False) -> DataFrame:
    """The parsed events of the files of a manifest selection."""
    empty = spark.createDataFrame([], "value string, source_file string")
    if log_type != "cloudtrail":
        lines = read_files(spark, files, ignore_corrupt=ignore_corrupt)
        return {"vpc": parse_vpc_lines, "s3": parse_s3_lines}[log_type](empty if lines is None else lines)
    by_line = F.regexp_replace("name", r"(?i)\.gz$", "").rlike(LINES_REGEX)
    documents, large = files.where(~by_line), []
    looked = [r.path for r in documents.where(is_large(F.col("bytes"), F.col("gzip"))).select("path").collect()]
    if looked:
        large = [_plain_path(p) for p in large_line_files(spark, looked, r"^", ignore_corrupt=ignore_corrupt)]
        documents = documents.where(~F.col("path").isin(large))
    docs = read_files(spark, documents, True, ignore_corrupt)
    lines = read_files(spark, files.where(by_line), False, ignore_corrupt)
    if large:
        more = read_text_files(spark, large, r"^", ignore_corrupt=ignore_corrupt, options=BY_LINE)
        lines = more if lines is None else lines.unionByName(more)
    out = parse_cloudtrail_docs(empty if docs is None else docs)
    return out if lines is None else out.unionByName(parse_cloudtrail_lines(lines))
