"""Report series: the small aggregates and labels the HTML pages chart.

They take the output of an analysis and add no scan of their own to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import col, div_mod, half_even, top_n, truncate_label

ARROW = " → "


def head(df: DataFrame, k: int) -> DataFrame:
    """First ``k`` rows of an ordered analysis (chart and table slices)."""
    return df.limit(k)


def login_status_counts(console_logins: DataFrame) -> DataFrame:
    """Login status distribution over the console-login listing."""
    agg = console_logins.groupBy("login_status").agg(F.count(F.lit(1)).alias("count"))
    return top_n(agg, "count", None, ["login_status"])


def top_creators(created_users: DataFrame, k: int = 10) -> DataFrame:
    """Users created per creator ARN, top ``k``."""
    agg = (created_users.filter(F.col("created_by_arn").isNotNull())
           .groupBy("created_by_arn").agg(F.count(F.lit(1)).alias("count")))
    return top_n(agg, "count", k, ["created_by_arn"])


def tactic_totals(tactic_hits: DataFrame, k: int = 8, hits_col: str = "hit_count") -> DataFrame:
    """Hits per tactic summed over names, top ``k``."""
    agg = tactic_hits.groupBy("tactic").agg(F.sum(hits_col).alias("total_hits"))
    return top_n(agg, "total_hits", k, ["tactic"])


def connection_label(src: str | Column = "source_ip", dst: str | Column = "destination_ip") -> Column:
    """``src → dst``."""
    return F.concat(col(src), F.lit(ARROW), col(dst))


def port_label(port: str | Column = "port") -> Column:
    """``Port 22``."""
    return F.concat(F.lit("Port "), col(port).cast("bigint").cast("string"))


def requester_label(arn: str | Column = "requester_arn", ip: str | Column = "source_ip") -> Column:
    """``arn (ip)``."""
    return F.concat(col(arn), F.lit(" ("), col(ip), F.lit(")"))


def operation_label(op: str | Column = "operation", bucket: str | Column = "bucket") -> Column:
    """``operation - bucket``."""
    return F.concat(col(op), F.lit(" - "), col(bucket))


def duration_hours(seconds: str | Column = "duration_seconds") -> Column:
    """Seconds -> hours rounded to 2 decimals (exact half-even), as a double."""
    s = col(seconds).cast("long")
    return half_even(*div_mod(s, F.lit(36)), F.lit(36)) / F.lit(100.0)


def session_hours(sessions: DataFrame) -> DataFrame:
    """Session-duration table with chart label and duration in hours."""
    return sessions.select(connection_label().alias("label"), "source_ip", "destination_ip",
                           duration_hours().alias("duration_hours"), "total_bytes")


def connection_labels(connections: DataFrame, value_col: str = "total_bytes") -> DataFrame:
    """Chart series ``(label, value)`` for a source/destination table."""
    return connections.select(connection_label().alias("label"), F.col(value_col).alias("value"))


def port_labels(ports: DataFrame) -> DataFrame:
    return ports.select(port_label().alias("label"), F.col("total_bytes").alias("value"))


def requester_labels(requesters: DataFrame) -> DataFrame:
    return requesters.select(requester_label().alias("label"), F.col("request_count").alias("value"))


def operation_labels(operations: DataFrame) -> DataFrame:
    return operations.select(operation_label().alias("label"), F.col("count").alias("value"))


def user_agent_labels(user_agents: DataFrame, chart_chars: int = 50, table_chars: int = 100) -> DataFrame:
    """User-agent class labels truncated for the chart (50) and the table (100)."""
    return user_agents.select(truncate_label("user_agent_type", chart_chars).alias("chart_label"),
                              truncate_label("user_agent_type", table_chars).alias("table_label"),
                              "usage_count")


def s3_event_preview(tactic_events: DataFrame, k: int = 20, key_chars: int = 50) -> DataFrame:
    """First ``k`` tagged S3 requests, key truncated to ``key_chars`` characters.

    The cut stands right above the listing, so an ordered listing is planned as
    a top-k: every partition keeps its own first ``k``, no full sort.
    """
    from ..sources.s3 import s3_time_offset

    return tactic_events.limit(k).select(
        "tactic", "operation", "bucket", truncate_label("key", key_chars).alias("key"),
        F.col("remote_ip").alias("source_ip"),
        F.date_format("request_datetime", "yyyy-MM-dd HH:mm:ss").alias("timestamp_utc"),
        s3_time_offset("original_timestamp").alias("timezone"))
