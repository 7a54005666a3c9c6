"""CloudTrail documents of any size, read by byte ranges in many tasks.

A ``Records`` document (or a top-level array) of gigabytes fits no row.  Spark's
text source splits it at every ``}`` (``lineSep``), by byte ranges, so rows are
the stretches between closing braces, in order within a range:

1. A stretch acts on the state (inside a string?, depth) in a way that needs no
   state to compute: whether it flips "inside", and how it changes the depth if it
   is entered outside or inside a string.  Escapes end before a brace, so they never
   reach over a stretch's end.  A range's stretches are composed in its task, to one row.
2. Ranges compose associatively: running sums over a file's ranges (a row each) give
   every range the state it is entered with.
3. With it a second pass cuts records: a stretch whose brace brings the depth back to
   that of the record array ends a record.  Records inside a range come out whole; what
   stands before a range's first record end and after its last is a fragment.
   Fragments of neighbouring ranges are put together by a count of record ends before
   them (a record reaches over as many ranges as its own size needs).
4. Text between records that opens arrays (``{"Records":[``) is kept as marks, a row or so
   a file; a record belongs to the array of the last mark before it, and only ``Records`` counts.

A document that breaks off keeps the records before the break.
"""

from __future__ import annotations

import re
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .cloudtrail import project_records, with_identity_columns
from .files import CLOUDTRAIL_NAME_REGEX

MANY_RANGES = 1 << 17     # ranges whose states are sent to the tasks at once; more are read in groups of files
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.S)
_GAP = b", \t\r\n"
# functions that run in tasks travel by value, so executors need no installed copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _outside(text: Column) -> Column:
    """Text entered outside a string, without its strings."""
    return F.regexp_replace(text, r'"[^"]*("|$)', "")


def _change(text: Column) -> Column:
    """How the brackets of text without strings (and without closing braces) change the depth."""
    opened = F.length(F.translate(text, "{[", ""))
    return (F.length(text) - opened - (F.length(text) - F.length(F.replace(text, F.lit("]"), F.lit(""))))).cast("long")


def stretches(spark: SparkSession, paths: list[str], name_regex: str = CLOUDTRAIL_NAME_REGEX) -> DataFrame:
    """The stretches of every file: value, file, name, start (of its range), flip, outer and inner (changes of depth)."""
    raw = (spark.read.option("recursiveFileLookup", "true").text(paths, lineSep="}")
           .where(F.col("_metadata.file_name").rlike(name_regex))
           .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"),
                   F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("bytes")))
    plain = raw.withColumn("plain", F.regexp_replace("value", r"(?s)\\.", ""))
    quotes = F.length("plain") - F.length(F.replace(F.col("plain"), F.lit('"'), F.lit("")))
    cut = plain.withColumns({"flip": (quotes % 2).cast("int"), "out": _outside(F.col("plain")),
                             "in": _outside(F.regexp_replace("plain", r'^[^"]*("|$)', ""))})
    # the closing brace that follows counts where it stands outside strings
    return cut.select("value", "file", "name", "start", "bytes", (F.octet_length("value") + 1).cast("long").alias("size"), "flip", (_change(F.col("out")) - F.when(F.col("flip") == 0, 1).otherwise(0)).alias("outer"),
                      (_change(F.col("in")) - F.when(F.col("flip") == 1, 1).otherwise(0)).alias("inner"),
                      F.substring(F.btrim("value", F.lit(" \t\r\n﻿")), 1, 1).alias("head"))


def _runs(b: pa.RecordBatch):
    """(first, last) of the rows of one range in a batch."""
    file, start = b.column("file").dictionary_encode().indices.to_numpy(), b.column("start").to_numpy()
    new = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    cuts = [0, *new.tolist(), b.num_rows]
    return zip(cuts, cuts[1:])


def _walk(flip: np.ndarray, outer: np.ndarray, inner: np.ndarray, inside: int):
    """Along stretches entered with ``inside``: inside after each, changes of depth of each."""
    after = (np.cumsum(flip) + inside) % 2
    before = (after - flip) % 2
    return after, np.where(before == 0, outer, inner)


def range_states(rows: DataFrame) -> DataFrame:
    """file, name, start, head and for every range the state it is entered with: inside, depth; and ``broken``,
    whether the file ends in this range without a brace (after its last row, then, there is none)."""
    def compose(batches):
        held = None                                     # file, name, start, head, flips, change if outside, if inside, size, bytes of the file

        def out(x):
            return pa.record_batch([pa.array([v]) for v in x], names=["file", "name", "start", "head", "flip", "outer", "inner", "size", "bytes"])

        for b in batches:
            if not b.num_rows:
                continue
            flip, outer, inner, size = (b.column(c).to_numpy() for c in ("flip", "outer", "inner", "size"))
            for x, y in _runs(b):
                file, start = b.column("file")[x].as_py(), b.column("start")[x].as_py()
                if held is None or (held[0], held[2]) != (file, start):
                    if held is not None:
                        yield out(held)
                    held = [file, b.column("name")[x].as_py(), start, b.column("head")[x].as_py(), 0, 0, 0, 0, b.column("bytes")[x].as_py()]
                sums = [int(_walk(flip[x:y], outer[x:y], inner[x:y], (held[4] + i) % 2)[1].sum()) for i in (0, 1)]
                held[5], held[6] = held[5] + sums[0], held[6] + sums[1]
                held[4] += int(flip[x:y].sum())
                held[7] += int(size[x:y].sum())
        if held is not None:
            yield out(held)

    small = rows.select("file", "name", "start", "head", "flip", "outer", "inner", "size", "bytes")
    ranges = small.mapInArrow(compose, "file string, name string, start long, head string, flip long, outer long, inner long, size long, bytes long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    entered = ranges.withColumn("inside", F.coalesce(F.sum("flip").over(before) % 2, F.lit(0)))
    entered = entered.withColumn("change", F.when(F.col("inside") == 0, F.col("outer")).otherwise(F.col("inner")))
    heads = F.first("head").over(Window.partitionBy("file").orderBy("start"))
    whole = Window.partitionBy("file")
    broken = (F.sum("size").over(whole) > F.col("bytes")) & (F.max("start").over(whole) == F.col("start"))
    return entered.select("file", "name", "start", heads.alias("head"), "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"),
                          broken.alias("broken"))


def opening(text: bytes, depth: int, level: int) -> tuple[int, bytes | None]:
    """Where, in text entered outside a string at ``depth``, the next record opens (-1: nowhere), and the key
    of the last array that the text before it opens in the document's object, as JSON text."""
    plain = text.lstrip(_GAP)
    if depth == level and plain[:1] == b"{":
        return len(text) - len(plain), None
    key, last = None, None
    for m in _TOKEN.finditer(text):
        token = m.group()
        if token == b"{" and depth == level:
            return m.start(), key
        if token[:1] == b'"':
            last = token
        else:
            if token == b"[" and depth == 1 and level == 2:
                key = last or b'""'
            depth += 1 if token in b"{[" else -1
    return -1, key


def _cut(rows: DataFrame, states: dict) -> DataFrame:
    """kind (0 whole record, 1 fragment before, 2 after the range's record ends, 3 of a range without), file, name, start, place, key, text."""
    shared = rows.sparkSession.sparkContext.broadcast(states)
    schema = "kind int, file string, name string, start long, place long, key string, depth long, text binary"

    def run(batches):
        now = None                                       # of the range at hand: file, name, start, level, inside, depth, place, ended
        open_text: list[bytes] = []                      # stretches since the last record end
        open_depth = 0                                   # the depth they begin at
        found: list[tuple] = []

        def close():
            """What is found of a range at its end, with the fragment behind its last record end."""
            if now["broken"] and now["ended"] and not open_text:
                return found[:-1]                        # no brace stands behind the file's last row: that record isn't whole
            kind = 2 if now["ended"] else 3
            return [*found, (kind, now["file"], now["name"], now["start"], now["place"], None, open_depth, b"".join(open_text))]

        def out(found):
            kind, file, name, start, place, key, depth, text = zip(*found)
            return pa.record_batch([pa.array(kind, pa.int32()), pa.array(file), pa.array(name), pa.array(start, pa.int64()), pa.array(place, pa.int64()),
                                    pa.array(key, pa.string()), pa.array(depth, pa.int64()), pa.array(text, pa.binary())],
                                   names=["kind", "file", "name", "start", "place", "key", "depth", "text"])

        for b in batches:
            if not b.num_rows:
                continue
            flip, outer, inner = (b.column(c).to_numpy() for c in ("flip", "outer", "inner"))
            values = b.column("value").cast(pa.binary()).to_pylist()
            for x, y in _runs(b):
                file, start = b.column("file")[x].as_py(), b.column("start")[x].as_py()
                if now is None or (now["file"], now["start"]) != (file, start):
                    if now is not None:
                        found = close()
                    head, inside, depth, broken = shared.value[file, start]
                    now = {"file": file, "name": b.column("name")[x].as_py(), "start": start, "level": 1 if head == "[" else 2,
                           "inside": inside, "depth": depth, "place": 0, "ended": False, "broken": broken}
                    open_text, open_depth = [], depth
                after, change = _walk(flip[x:y], outer[x:y], inner[x:y], now["inside"])
                depths = now["depth"] + np.cumsum(change)
                at = x
                for end in np.flatnonzero((after == 0) & (depths == now["level"])).tolist():
                    text = b"".join(open_text) + b"}".join(values[at:x + end + 1]) + b"}"
                    at, open_text = x + end + 1, []
                    if now["ended"]:
                        begin, key = opening(text, open_depth, now["level"])
                        if begin >= 0:
                            found.append((0, file, now["name"], start, now["place"], None if key is None else key.decode("utf-8", "replace"),
                                          0, text[begin:]))
                    else:
                        found.append((1, file, now["name"], start, -1, None, open_depth, text))
                    now["place"] += 1
                    now["ended"], open_depth = True, now["level"]
                if at < y:
                    open_text.append(b"}".join(values[at:y]) + b"}")
                now["inside"], now["depth"] = int(after[-1]), int(depths[-1])
                if len(found) > 1000:
                    yield out(found[:-1])
                    found = found[-1:]
        if now is not None and (found := close()):
            yield out(found)

    return rows.select("value", "file", "name", "start", "flip", "outer", "inner").mapInArrow(run, schema)


def _joined(cut: DataFrame) -> DataFrame:
    """Fragments put together: file, name, start, place, key, text of the records that reach over ranges."""
    ends = cut.where("kind in (1, 3)").select("file", "start", (F.col("kind") == 1).cast("long").alias("ended"))
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    number = ends.select("file", "start", F.coalesce(F.sum("ended").over(upto), F.lit(0)).alias("before"))
    parts = cut.where("kind > 0").join(number, ["file", "start"])
    # a range's last fragment begins the next record; its first one ends the record begun before
    parts = parts.withColumn("record", F.col("before") + (F.col("kind") == 2).cast("long"))
    whole = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "place", "depth", "text"))).alias("p"),
                                               F.first("name").alias("name"))
    first = F.col("p")[0]
    texts = whole.select("file", "name", first["start"].alias("start"), first["place"].alias("place"), first["depth"].alias("depth"),
                         F.expr("aggregate(p, cast('' AS BINARY), (t, x) -> concat(t, x.text))").alias("text"),
                         F.expr("p[size(p) - 1].kind = 1").alias("ended"))
    return texts


def _opened(texts: DataFrame, levels: dict) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for b in batches:
            keys, records = [], []
            for file, depth, text, ended in zip(*(b.column(c).to_pylist() for c in ("file", "depth", "text", "ended"))):
                begin, key = opening(text, depth, shared.value[file])
                keys.append(None if key is None else key.decode("utf-8", "replace"))
                records.append(text[begin:] if begin >= 0 and ended else None)
            yield pa.record_batch([b.column("file"), b.column("name"), b.column("start"), b.column("place"), pa.array(keys, pa.string()),
                                   pa.array(records, pa.binary())], names=["file", "name", "start", "place", "key", "text"])

    return texts.select("file", "name", "start", "place", "depth", "text", "ended").mapInArrow(
        run, "file string, name string, start long, place long, key string, text binary")


def _group_records(spark: SparkSession, rows: DataFrame, states: list) -> DataFrame:
    entered = {(r.file, r.start): (r.head, int(r.inside), int(r.depth), r.broken) for r in states}
    levels = {r.file: 1 if r.head == "[" else 2 for r in states}
    path = f"{checkpoint_dir(spark)}/logsift-ranges-{uuid.uuid4().hex}"
    _cut(rows, entered).write.parquet(path)
    cut = spark.read.parquet(path)
    found = cut.where("kind = 0").select("file", "name", "start", "place", "key", "text").unionByName(_opened(_joined(cut), levels))
    # marks: text that opens an array of the document's object; a record is in the array of the last mark up to it
    at = F.struct("start", "place")
    marks = found.where("key is not null").select("file", at.alias("begin"), F.from_json(F.concat(F.lit('{"k":'), "key", F.lit("}")), "k string")["k"].alias("array"))
    upto = Window.partitionBy("file").orderBy("begin")
    marks = marks.withColumn("end", F.lead("begin").over(upto)).where("array = 'Records'")
    records = found.where("text is not null").select("file", "name", at.alias("at"), F.col("text").cast("string").alias("rec"))
    arrays = [f for f, level in levels.items() if level == 1]
    # a row or so a file, of at most MANY_RANGES files
    inside = records.join(F.broadcast(marks), (records["file"] == marks["file"]) & (records["at"] >= marks["begin"])
                          & (marks["end"].isNull() | (records["at"] < marks["end"])), "left_semi")
    if arrays:
        tops = spark.createDataFrame([(f,) for f in arrays], "file string")
        inside = inside.union(records.join(F.broadcast(tops), "file", "left_semi").select(*records.columns))
    return inside.select("rec", F.col("name").alias("source_file"))


def range_records(spark: SparkSession, path: str | list[str], name_regex: str = CLOUDTRAIL_NAME_REGEX) -> DataFrame:
    """``(rec, source_file)``: the text of every record object of every document under ``path``.

    Uncompressed files only: gzip can't be entered in the middle.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rows = stretches(spark, paths, name_regex)
    kept = f"{checkpoint_dir(spark)}/logsift-range-states-{uuid.uuid4().hex}"
    range_states(rows).write.parquet(kept)
    table = spark.read.parquet(kept)
    sizes = table.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()
    groups, size = [[]], 0
    for r in sizes:
        if size and size + r.n > MANY_RANGES:
            groups.append([])
            size = 0
        groups[-1].append(r.file)
        size += r.n
    out = None
    for files in groups:
        own = rows if len(groups) == 1 else stretches(spark, files, name_regex)
        states = (table if len(groups) == 1 else table.where(F.col("file").isin(files))).collect()
        part = _group_records(spark, own, states)
        out = part if out is None else out.union(part)
    return out


def read_cloudtrail_ranges(spark: SparkSession, path: str | list[str], name_regex: str = CLOUDTRAIL_NAME_REGEX, offsets: dict | None = None,
                           columns: list[str] | None = None) -> DataFrame:
    """Like :func:`~logsift.sources.cloudtrail.read_cloudtrail` for ``Records`` documents and arrays of any size."""
    return with_identity_columns(project_records(range_records(spark, path, name_regex), offsets, columns))
