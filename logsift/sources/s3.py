"""S3 server-access-log source: log lines -> typed ``s3_access`` table.

The grammar follows the published field list: 26 fields, of which the time is
bracketed and the request URI, referer and user agent are quoted (or ``-``);
fields may be appended to the format, and are kept in ``extra_fields``.  A line
that matches is split in one regex pass (``regexp_replace`` to a \\x01-separated
record, then ``split``) instead of 26 ``regexp_extract`` calls.  Other lines go
through a quote- and bracket-aware tokeniser that fills the fields it finds, in
order (``parse_status = 'fallback'``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import blank_to_null, instant_to_ntz, strip_ws, to_integer
from ..schemas import S3_FIELDS
from .files import FLOW_NAME_REGEX, Rejects, read_text_files

_SEP = "\u0001"
_N = len(S3_FIELDS)
# plain fields, the bracketed time, and quoted text that may hold quotes not followed by a blank
_PLAIN, _TIME, _TEXT = r"(\S+)", r"(\[[^\]]*\])", r'("[^"]*(?:"(?!\s)[^"]*)*"|-)'
_FORMS = {"original_timestamp": _TIME, "request_uri": _TEXT, "referer": _TEXT, "user_agent": _TEXT}
LINE_PATTERN = "^" + r"\s+".join(_FORMS.get(name, _PLAIN) for name in S3_FIELDS) + r"(?:\s+(.*))?$"
_REPLACEMENT = _SEP.join(f"${i}" for i in range(1, _N + 2))
# token = run of quoted segments, bracketed segments and plain characters
_TOKEN = r'((?:"[^"]*(?:"|$)|\[[^\]]*\]|[^ "])+)'
_QUOTED = {"request_uri", "referer", "user_agent"}
_INT_FIELDS = {"http_status_code": "int", "bytes_sent": "bigint", "object_size": "bigint",
               "total_time": "bigint", "turn_around_time": "bigint"}
_S3_TIME_FORMAT = "'['dd/MMM/yyyy:HH:mm:ss Z']'"


def s3_time(text: str | Column) -> Column:
    """``[01/Oct/2025:11:55:11 +0000]`` -> UTC TIMESTAMP_NTZ (offset applied); else NULL."""
    c = F.col(text) if isinstance(text, str) else text
    return instant_to_ntz(F.try_to_timestamp(c, F.lit(_S3_TIME_FORMAT)))


def s3_time_offset(text: str | Column) -> Column:
    """The ``±zzzz`` offset of an S3 time, default ``+0000``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.nullif(F.regexp_extract(c, r"([+-]\d{4})\]", 1), F.lit("")), F.lit("+0000"))


def parse_s3_lines(lines: DataFrame, rejects: Rejects | None = None) -> DataFrame:
    """``(value, source_file)`` lines -> ``s3_access`` rows (per-row work only, no shuffle).

    ``rejects`` counts the lines that only the fallback could read.
    """
    # one line -> zero or one record: a generator, so the line expression is
    # computed once (see parse_vpc_lines)
    line = F.col("line")
    staged = lines.select(strip_ws("value").alias("line"), "source_file").select(
        F.explode(F.when((line != "") & ~line.startswith("#"), F.array(line))
                  .otherwise(F.array().cast("array<string>"))).alias("line"), "source_file")
    # One grammar pass per line: regexp_replace returns the line unchanged when
    # the (anchored) grammar does not match, and a changed line when it does
    # (the blanks between the 26 fields become \x01, which \s never matches).
    # The rewrite gets its own projection so the test below reads a column.
    staged = staged.select("line", F.regexp_replace("line", LINE_PATTERN, _REPLACEMENT).alias("rec"),
                           "source_file")
    full = F.col("rec") != F.col("line")
    staged = staged.select(
        F.when(full, F.split("rec", _SEP)).otherwise(F.regexp_extract_all("line", F.lit(_TOKEN), 1)).alias("f"),
        F.when(full, F.lit("full")).otherwise(F.lit("fallback")).alias("parse_status"),
        "source_file",
    )
    if rejects is not None:
        staged = rejects.watch(staged, (F.col("parse_status") == "fallback").cast("int"))
    out = []
    for i, name in enumerate(S3_FIELDS):
        v = F.get(F.col("f"), i)
        if name in _QUOTED:
            v = F.btrim(v, F.lit('"'))
        v = blank_to_null(v)
        if name in _INT_FIELDS:
            v = to_integer(v, _INT_FIELDS[name])
        out.append(v.alias(name))
        if name == "original_timestamp":
            out.append(s3_time(blank_to_null(F.get(F.col("f"), i))).alias("request_datetime"))
    f = F.col("f")
    more = F.when(F.size(f) > _N, F.array_join(F.slice(f, _N + 1, F.greatest(F.size(f) - _N, F.lit(0))), " "))
    return staged.select(*out, "source_file", "parse_status", blank_to_null(more).alias("extra_fields"))


def s3_rejects(lines: DataFrame) -> DataFrame:
    """``(source_file, reason, rejected)``: lines not read as records, and records read by the fallback."""
    line = strip_ws("value")
    reason = F.when(line == "", "blank").when(line.startswith("#"), "comment").when(~line.rlike(LINE_PATTERN), "fallback")
    return (lines.select("source_file", reason.alias("reason")).where("reason is not null")
            .groupBy("source_file", "reason").agg(F.count(F.lit(1)).alias("rejected")))


def read_s3_access(spark: SparkSession, path: str | list[str], rejects: Rejects | None = None, **options) -> DataFrame:
    """Scan an S3 access-log directory (recursive; ``.log .txt .gz`` or dated names)."""
    return parse_s3_lines(read_text_files(spark, path, FLOW_NAME_REGEX, wholetext=False, **options), rejects)
