"""S3 server-access-log analyses over a parsed ``s3_access`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lookups
from ..functions.classify import class_counts, classify_user_agent_coarse, split_requester
from ..functions.common import order_desc, top_n, with_pct
from ..schemas import S3_EVENT_DISPLAY_NAMES
from .enrich import tactic_lookup, tag_tactics


def s3_requesters(df: DataFrame, top_n_rows: int | None = 20, filter_first: bool = False) -> DataFrame:
    """Requests per (requester, source IP).

    The requester is decomposed into a display ARN and an IP; the source IP is
    ``remote_ip``, else the requester's IP.  As in the original report the
    top-N cut is taken first and rows whose ARN or IP is ``N/A`` are removed
    after it (so fewer than N rows may remain); ``filter_first=True`` removes
    them before ranking instead.
    """
    pairs = requester_pairs(df)
    usable = (F.col("requester_arn") != "N/A") & (F.col("source_ip") != "N/A")
    if filter_first:
        pairs = pairs.filter(usable)
    return rank_requesters(pairs.groupBy("requester_arn", "source_ip").agg(F.count(F.lit(1)).alias("request_count")), top_n_rows)


def requester_pairs(df: DataFrame) -> DataFrame:
    """``(requester_arn, source_ip)`` of every request."""
    # the split is a column of its own, read twice below (once conditionally,
    # inside coalesce, which would otherwise re-run the regexes)
    split = df.withColumn("__requester", split_requester("requester"))
    r = F.col("__requester")
    pairs = split.withColumns({"requester_arn": r["arn"], "source_ip": F.coalesce(F.col("remote_ip"), r["ip"])})
    return pairs.drop("__requester")


def rank_requesters(agg: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """``(requester_arn, source_ip, request_count)`` -> the first rows, then without ``N/A``."""
    ranked = top_n(agg, "request_count", top_n_rows, ["requester_arn", "source_ip"])
    return ranked.filter((F.col("requester_arn") != "N/A") & (F.col("source_ip") != "N/A"))


def s3_operations(df: DataFrame, top_n_rows: int | None = 20, prefix_depth: int | None = None) -> DataFrame:
    """Object operations (PUT/GET/DELETE/COPY) per (operation, bucket, key), top N by count.

    The key is reported without its leading ``/``.  ``prefix_depth=n`` groups
    by the first ``n`` path segments instead of the full key.
    """
    ops = df.filter(F.col("operation").isin(lookups.S3_OBJECT_OPERATIONS) & F.col("key").isNotNull()
                    & F.col("bucket").isNotNull())
    key = F.col("key") if prefix_depth is None else F.substring_index(F.ltrim(F.col("key"), F.lit("/")), "/", prefix_depth)
    agg = ops.groupBy("operation", "bucket", key.alias("k")).agg(F.count(F.lit(1)).alias("count"))
    return rank_operations(agg, top_n_rows)


def rank_operations(agg: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """``(operation, bucket, k, count)`` -> the table of :func:`s3_operations`."""
    ranked = top_n(agg, "count", top_n_rows, ["operation", "bucket", "k"])
    return ranked.select("operation", "bucket", F.coalesce(F.ltrim(F.col("k"), F.lit("/")), F.lit("(root)"))
                         .alias("prefix"), "count")


def s3_user_agents(df: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """Coarse user-agent class frequency with % of all requests; top N classes."""
    return rank_user_agents(class_counts(df, "user_agent", classify_user_agent_coarse, "user_agent_type", "usage_count"), top_n_rows)


def rank_user_agents(agg: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    return top_n(with_pct(agg, "usage_count", "usage_pct"), "usage_count", top_n_rows, ["user_agent_type"])


def _lookup(df: DataFrame, lookup: DataFrame | None, policy: str | None) -> DataFrame:
    return lookup if lookup is not None else tactic_lookup(df.sparkSession, "s3_access_log", policy=policy)


def s3_tactics(df: DataFrame, lookup: DataFrame | None = None, policy: str | None = None) -> DataFrame:
    """(tactic, operation) hit counts with % of all requests; unmapped operations skipped.

    Requests are counted per operation first; the lookup joins the small
    aggregate and the total comes from the same aggregate (one scan).
    """
    # non-NULL key: otherwise the join's inferred "key IS NOT NULL" would be pushed
    # below the aggregation and the total could no longer reuse its shuffle
    by_op = df.groupBy(F.coalesce("operation", F.lit("")).alias("operation")).agg(F.count(F.lit(1)).alias("hit_count"))
    return tactic_hits(by_op, _lookup(df, lookup, policy))


def tactic_hits(by_op: DataFrame, lookup: DataFrame) -> DataFrame:
    """``(operation, hit_count)`` of all requests -> the table of :func:`s3_tactics`."""
    total = by_op.select(F.sum("hit_count")).scalar()
    hits = tag_tactics(by_op, lookup, "operation", how="inner")
    out = with_pct(hits.select("tactic", "operation", "hit_count"), "hit_count", "operation_pct", total)
    return out.orderBy(*order_desc("hit_count", ["tactic", "operation"]))


def s3_tactic_events(df: DataFrame, lookup: DataFrame | None = None, policy: str | None = None,
                     display_names: bool = False, sort: bool = False) -> DataFrame:
    """Every request with a mapped tactic, tactic first.

    Input order, like the original listing (no shuffle); ``sort=True`` orders
    by request time and request id.  ``display_names=True`` renames columns
    to the report headers (``Operation``, ``Source IP``, ``Timestamp (UTC)``, ...).
    """
    tagged = tag_tactics(df, _lookup(df, lookup, policy), "operation", how="inner")
    out = tagged.select("tactic", *df.columns)
    if sort:
        out = out.orderBy(F.col("request_datetime").asc_nulls_last(), F.col("request_id").asc_nulls_last())
    if display_names:
        out = out.withColumnsRenamed({k: v for k, v in S3_EVENT_DISPLAY_NAMES.items() if k in out.columns}
                                     | {"tactic": "MITRE ATT&CK"})
    return out
