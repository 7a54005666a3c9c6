"""VPC Flow Log source: whitespace-separated lines -> typed ``vpc_flow`` table.

Line format (default version-2 record)::

    version account-id interface-id srcaddr dstaddr srcport dstport protocol
    packets bytes start end action log-status

Dropped: blank and ``#`` lines, header lines (field 0 is ``version``/``start``/
``end`` or field 10 is ``start``/``end``) and lines with fewer than 13 fields.
Numeric fields that are not numbers (``-`` on NODATA records) become NULL;
epoch seconds become UTC ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import blank_to_null, epoch_seconds_to_ntz, parse_naive, to_integer
from .files import FLOW_NAME_REGEX, Rejects, read_text_files

_HEADER_FIRST = ["version", "start", "end"]
_HEADER_TENTH = ["start", "end"]
_NUMERIC = {"srcport": 5, "dstport": 6, "protocol": 7, "packets": 8, "bytes": 9}


def flow_time(text: Column) -> Column:
    """Epoch-seconds text -> UTC NTZ; other text is parsed as a datetime, else NULL."""
    return F.when(text.rlike("^[0-9]+$"), epoch_seconds_to_ntz(text.try_cast("bigint"))).otherwise(parse_naive(text))


def whitespace_tokens(text: Column) -> Column:
    """Split on runs of whitespace, ignoring leading/trailing whitespace (like ``str.split()``).

    Lines without tabs/LF/CR/FF/VT take Java's single-character split (no regex);
    only the others pay for ``\\s+``.  Empty tokens from repeated or edge blanks
    are removed.
    """
    other_ws = (text.contains("\t") | text.contains("\n") | text.contains("\r") | text.contains("\f")
                | text.contains("\u000b"))
    parts = F.when(other_ws, F.split(text, r"\s+")).otherwise(F.split(text, " "))
    return F.array_remove(parts, "")


def _reject_reason(p: Column) -> Column:
    """Why the tokens of a line are no record; NULL for records."""
    return (F.when(F.size(p) == 0, "blank").when(F.get(p, 0).startswith("#"), "comment")
            .when(F.size(p) < 13, "too few fields")
            .when(F.get(p, 0).isin(_HEADER_FIRST) | F.get(p, 10).isin(_HEADER_TENTH), "header"))


def vpc_rejects(lines: DataFrame) -> DataFrame:
    """``(source_file, reason, rejected)``: the lines that are no records, per file and reason."""
    tokens = lines.select(whitespace_tokens(F.coalesce("value", F.lit(""))).alias("p"), "source_file")
    reasons = tokens.select("source_file", _reject_reason(F.col("p")).alias("reason")).where("reason is not null")
    return reasons.groupBy("source_file", "reason").agg(F.count(F.lit(1)).alias("rejected"))


def parse_vpc_lines(lines: DataFrame, rejects: Rejects | None = None) -> DataFrame:
    """``(value, source_file)`` lines -> ``vpc_flow`` rows (per-row work only, no shuffle).

    Each line yields zero or one record, expressed as a generator: the line is
    tokenised once and ``explode`` emits the token array only for record
    lines.  (A plain ``filter`` on the tokens would be pushed below the
    tokenising projection by the optimizer, re-running the split, and the
    expression that produced ``value``, once per predicate.)  Blank lines have
    no tokens; comment lines are those whose first token starts with ``#``.
    """
    p = F.col("p")
    tokens = lines.select(whitespace_tokens(F.coalesce("value", F.lit(""))).alias("p"), "source_file")
    if rejects is not None:
        tokens = rejects.watch(tokens, (_reject_reason(p) == "too few fields").cast("int"))
    staged = tokens.select(
        F.explode(F.when(_reject_reason(p).isNull(), F.array(p)).otherwise(F.array().cast("array<array<string>>"))).alias("p"),
        "source_file")
    p = F.col("p")
    return staged.select(
        F.get(p, 0).alias("version"),
        F.get(p, 1).alias("account_id"),
        F.get(p, 2).alias("interface_id"),
        F.get(p, 3).alias("srcaddr"),
        F.get(p, 4).alias("dstaddr"),
        *[to_integer(F.get(p, i)).alias(name) for name, i in _NUMERIC.items()],
        flow_time(F.get(p, 10)).alias("window_start"),
        flow_time(F.get(p, 11)).alias("window_end"),
        F.get(p, 12).alias("action"),
        blank_to_null(F.get(p, 13)).alias("flow_log_status"),
        F.col("source_file"),
    )


def read_vpc_flow(spark: SparkSession, path: str | list[str], rejects: Rejects | None = None, **options) -> DataFrame:
    """Scan a VPC Flow Log directory (recursive; ``.log .txt .gz`` or dated names)."""
    return parse_vpc_lines(read_text_files(spark, path, FLOW_NAME_REGEX, wholetext=False, **options), rejects)
