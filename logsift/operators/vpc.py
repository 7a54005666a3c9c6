"""VPC Flow Log analyses over a parsed ``vpc_flow`` table.

Every analysis is one scan, one partially-aggregated shuffle on its group key
and (for top-N reports) a ``TakeOrderedAndProject``.  Sums skip NULLs and give
0 for an all-NULL group; rows whose group key is NULL are not grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import night_rows, sum0, top_n
from .enrich import port_service_lookup, protocol_name

TYPE_SOURCE = "Source IP"
TYPE_DESTINATION = "Destination IP"


def vpc_top_ips(df: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """Top IPs by bytes over source and destination roles (each role ranked as its own row).

    One scan: every flow is unpivoted into its (source, destination) roles
    before the partial aggregation, so there is a single shuffle keyed by
    ``(type, ip)`` instead of two aggregates and a union.
    """
    roles = (df.select("srcaddr", "dstaddr", "bytes", "packets")
             .unpivot(["bytes", "packets"], ["srcaddr", "dstaddr"], "role", "ip")
             .filter(F.col("ip").isNotNull()))
    agg = (roles.groupBy("role", "ip")
           .agg(sum0("bytes").alias("total_bytes"), sum0("packets").alias("total_packets"))
           .select("ip", "total_bytes",
                   F.when(F.col("role") == "srcaddr", TYPE_SOURCE).otherwise(TYPE_DESTINATION).alias("type"),
                   "total_packets"))
    return rank_ips(agg, top_n_rows)


def rank_ips(agg: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    return top_n(agg, "total_bytes", top_n_rows, ["ip", "type"], sums=True)


def vpc_top_ports(df: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """Top (destination port, protocol) pairs by bytes, with flow counts; protocol shown by name."""
    agg = (df.filter(F.col("dstport").isNotNull() & F.col("protocol").isNotNull())
           .groupBy("dstport", "protocol")
           .agg(F.count(F.lit(1)).alias("flow_count"), sum0("bytes").alias("total_bytes")))
    return rank_ports(agg, top_n_rows)


def rank_ports(agg: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """``(dstport, protocol, flow_count, total_bytes)`` -> the table of :func:`vpc_top_ports`."""
    ranked = top_n(agg, "total_bytes", top_n_rows, ["dstport", "protocol"], sums=True)
    return ranked.select(F.col("dstport").alias("port"), protocol_name("protocol").alias("protocol"),
                         "flow_count", "total_bytes")


def vpc_night_remote(df: DataFrame, ports: dict | None = None, start_hour: int = 22, end_hour: int = 6,
                     inclusive_end: bool = False) -> DataFrame:
    """Remote-access flows (SSH, RDP, VNC, ...) starting at night (UTC hour of window start).

    The port list is a small broadcast lookup: an inner broadcast hash join
    filters and names the service in the map stage, before the shuffle.
    """
    night = df.filter(night_rows(df, "window_start", start_hour, end_hour, inclusive_end))
    svc = port_service_lookup(df.sparkSession, ports)
    remote = night.join(svc, night["dstport"] == svc["port"], "inner").drop("port")
    agg = (remote.filter(F.col("srcaddr").isNotNull() & F.col("dstaddr").isNotNull() & F.col("protocol").isNotNull())
           .groupBy("srcaddr", "dstaddr", "dstport", "protocol", "service")
           .agg(sum0("bytes").alias("total_bytes"), sum0("packets").alias("total_packets")))
    return rank_night_remote(agg)


def rank_night_remote(agg: DataFrame) -> DataFrame:
    """``(srcaddr, dstaddr, dstport, protocol, service, total_bytes, total_packets)`` -> the table of :func:`vpc_night_remote`."""
    ranked = top_n(agg, "total_bytes", None, ["srcaddr", "dstaddr", "dstport", "protocol"], sums=True)
    return ranked.select(F.col("srcaddr").alias("source_ip"), F.col("dstaddr").alias("destination_ip"),
                         F.col("dstport").alias("port"), protocol_name("protocol").alias("protocol"),
                         "service", "total_bytes", "total_packets")


def flow_duration_seconds(df: DataFrame) -> F.Column:
    return F.timestamp_diff("SECOND", F.col("window_start"), F.col("window_end"))


def vpc_session_duration(df: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """Longest (source, destination) sessions: max flow duration > 0 s, with byte/packet sums."""
    flows = (df.withColumn("duration", flow_duration_seconds(df))
             .filter((F.col("duration") > 0) & F.col("srcaddr").isNotNull() & F.col("dstaddr").isNotNull()))
    agg = (flows.groupBy("srcaddr", "dstaddr")
           .agg(F.max("duration").alias("duration_seconds"), sum0("bytes").alias("total_bytes"),
                sum0("packets").alias("total_packets")))
    return rank_sessions(agg, top_n_rows)


def rank_sessions(agg: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """``(srcaddr, dstaddr, duration_seconds, total_bytes, total_packets)`` -> the table of :func:`vpc_session_duration`."""
    ranked = top_n(agg, "duration_seconds", top_n_rows, ["srcaddr", "dstaddr"])
    return ranked.select(F.col("srcaddr").alias("source_ip"), F.col("dstaddr").alias("destination_ip"),
                         "duration_seconds", "total_bytes", "total_packets")


def vpc_top_connections(df: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """Top (source, destination) pairs by bytes, with packets and flow count (one aggregate)."""
    agg = (df.filter(F.col("srcaddr").isNotNull() & F.col("dstaddr").isNotNull())
           .groupBy("srcaddr", "dstaddr")
           .agg(sum0("bytes").alias("total_bytes"), sum0("packets").alias("total_packets"),
                F.count(F.lit(1)).alias("flow_count")))
    return rank_connections(agg, top_n_rows)


def rank_connections(agg: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """``(srcaddr, dstaddr, total_bytes, total_packets, flow_count)`` -> the table of :func:`vpc_top_connections`."""
    ranked = top_n(agg, "total_bytes", top_n_rows, ["srcaddr", "dstaddr"], sums=True)
    return ranked.select(F.col("srcaddr").alias("source_ip"), F.col("dstaddr").alias("destination_ip"),
                         "total_bytes", "total_packets", "flow_count")


def vpc_top_connections_joined(df: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """Same result as :func:`vpc_top_connections`, computed the original way: a sums aggregate
    joined with a counts aggregate on (source, destination).  Kept as a cross-check of the
    single-aggregate plan; both inputs are co-partitioned on the join keys."""
    base = df.filter(F.col("srcaddr").isNotNull() & F.col("dstaddr").isNotNull())
    sums = base.groupBy("srcaddr", "dstaddr").agg(sum0("bytes").alias("total_bytes"),
                                                  sum0("packets").alias("total_packets"))
    counts = base.groupBy("srcaddr", "dstaddr").agg(F.count(F.lit(1)).alias("flow_count"))
    return rank_connections(sums.join(counts, ["srcaddr", "dstaddr"], "inner"), top_n_rows)
