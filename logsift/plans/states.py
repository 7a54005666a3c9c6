"""Mergeable partial states: one pass over the events feeds every ranked table, and days are added one by one.

``event_states`` turns parsed events into a long table of partial aggregates, a
row per event date, dimension (``dim``) and key ``k1..k4``: counts, sums, the largest
duration, first and last times.  Every event is taken apart into the dimensions it
belongs to by one generator (a night dimension only for night events, a failure
category only for failures), then partially aggregated: one scan, one shuffle, and a
hot key is a row per task.  Counts and sums add up, minima and maxima combine,
so states of several days merge into those of the whole time.

``ranked_tables`` makes the ranked tables of a bundle from (merged) states, with
the same final steps as the analyses over events.  ``update_states`` keeps a states
table by increments: it aggregates the delivered days only and replaces those days
(a day delivered twice counts once), so a run reads new days and small states
instead of the whole history.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lookups
from ..functions.classify import classify_user_agent, classify_user_agent_coarse
from ..functions.common import night_window, sum0
from ..operators import cloudtrail as ct
from ..operators import s3 as s3a
from ..operators import vpc as vpca
from ..operators.enrich import port_service_lookup, tactic_lookup

TIME_COLUMN = {"cloudtrail": "event_time", "vpc": "window_start", "s3": "request_datetime"}
KEYS = ["dim", "k1", "k2", "k3", "k4"]
VALUES = ["n", "s1", "s2", "longest", "first_utc", "first_local", "last_utc", "last_local"]
SCHEMA = ("dim string, k1 string, k2 string, k3 string, k4 string, n bigint, s1 bigint, s2 bigint, longest bigint, "
          "first_utc timestamp_ntz, first_local timestamp_ntz, last_utc timestamp_ntz, last_local timestamp_ntz, event_date date")
DAY = "day"                # the dimension of the events of a day, present for every day that was delivered


def _entry(dim: str | Column, *keys: Column, s1: Column | None = None, s2: Column | None = None, longest: Column | None = None,
           utc: Column | None = None, local: Column | None = None) -> Column:
    """One dimension of an event; what it doesn't have is NULL."""
    padded = [*keys, *[None] * (4 - len(keys))]
    fields = [(F.lit(dim) if isinstance(dim, str) else dim).alias("dim")]
    fields += [(F.lit(None) if k is None else k).cast("string").alias(f"k{i}") for i, k in enumerate(padded, 1)]
    for name, value, kind in (("s1", s1, "bigint"), ("s2", s2, "bigint"), ("longest", longest, "bigint"),
                              ("utc", utc, "timestamp_ntz"), ("local", local, "timestamp_ntz")):
        fields.append((F.lit(None) if value is None else value).cast(kind).alias(name))
    return F.struct(*fields)


def _cloudtrail_entries(df: DataFrame, user_field: str | list[str]) -> tuple[DataFrame, Column]:
    df = ct._with_failure_text(ct.ensure_identity(df))
    hour = F.hour("event_time_local")
    df = df.withColumns({"__ua": classify_user_agent("user_agent"), "__night": night_window(hour),
                         "__night_incl": night_window(hour, inclusive_end=True), "__user": ct._user_value(user_field),
                         "__categories": ct._failure_categories()})
    ip = F.col("source_ip_address")
    fixed = F.array(
        _entry(DAY), _entry("event_name", F.col("event_name")), _entry("aws_region", F.col("aws_region")), _entry("ua", F.col("__ua")),
        F.when(ip.isNotNull(), _entry("ip", ip, utc=F.col("event_time"), local=F.col("event_time_local"))),
        F.when(F.col("__night") & ip.isNotNull(), _entry("night_ip", ip)),
        F.when(F.col("__night_incl"), _entry("night_event", F.col("event_name"))))
    failed = F.flatten(F.transform("__categories", lambda c: F.array(
        _entry("failed", c, F.lit("IPs"), ip), _entry("failed", c, F.lit("Users"), F.col("__user")))))
    return df, F.concat(F.array_compact(fixed), failed)


def _vpc_sums(df: DataFrame) -> DataFrame:
    """Flows -> sums by event date and, as ``part`` says, by pair of addresses, by port, or by both (remote access at
    night): about two rows a flow, of which the dimensions that share keys are made afterwards."""
    df = df.withColumns({"__seconds": vpca.flow_duration_seconds(df), "__night": night_window(F.hour("window_start"))})
    src, dst, port, protocol = (F.col(c) for c in ("srcaddr", "dstaddr", "dstport", "protocol"))
    pair = src.isNotNull() & dst.isNotNull()
    remote = pair & F.col("__night") & protocol.isNotNull() & port.isin([int(p) for p in lookups.REMOTE_ACCESS_PORTS])

    def part(name: str, *keys: str) -> Column:
        return F.struct(F.lit(name).alias("part"), *[(F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType)).alias(c)
                                                     for c in ("srcaddr", "dstaddr", "dstport", "protocol")])

    parts = F.array_compact(F.array(
        part("pair", "srcaddr", "dstaddr"), F.when(port.isNotNull() & protocol.isNotNull(), part("port", "dstport", "protocol")),
        F.when(remote, part("remote", "srcaddr", "dstaddr", "dstport", "protocol"))))
    each = df.select(
        F.to_date("window_start").alias("event_date"), F.col("bytes").cast("bigint").alias("bytes"), F.col("packets").cast("bigint").alias("packets"),
        F.when(pair & (F.col("__seconds") > 0), F.col("__seconds")).cast("bigint").alias("seconds"), F.explode(parts).alias("e"))
    timed = F.col("seconds").isNotNull()
    return each.select("event_date", "e.*", "bytes", "packets", "seconds").groupBy("event_date", "part", "srcaddr", "dstaddr", "dstport", "protocol").agg(
        F.count(F.lit(1)).alias("flows"), sum0("bytes").alias("bytes"), sum0("packets").alias("packets"), F.count("seconds").alias("sessions"),
        sum0(F.when(timed, F.col("bytes"))).alias("session_bytes"), sum0(F.when(timed, F.col("packets"))).alias("session_packets"),
        F.max("seconds").alias("longest"))


def _vpc_states(df: DataFrame) -> DataFrame:
    src, dst, port, protocol = (F.col(c) for c in ("srcaddr", "dstaddr", "dstport", "protocol"))

    def entry(dim: str, *keys: Column, n: str = "flows", s1: Column = F.col("bytes"), s2: Column = F.col("packets"), longest: Column | None = None) -> Column:
        return F.struct(F.col(n).alias("n"), *[_entry(dim, *keys, s1=s1, s2=s2, longest=longest)[c].alias(c) for c in (*KEYS, "s1", "s2", "longest")])

    paired, none = F.col("part") == "pair", F.lit(0)
    pair = paired & src.isNotNull() & dst.isNotNull()
    entries = F.array_compact(F.array(
        F.when(paired, entry(DAY, s1=none, s2=none)),
        F.when(paired & src.isNotNull(), entry("ip", src, F.lit(vpca.TYPE_SOURCE))),
        F.when(paired & dst.isNotNull(), entry("ip", dst, F.lit(vpca.TYPE_DESTINATION))),
        F.when(F.col("part") == "port", entry("port", port, protocol)),
        F.when(F.col("part") == "remote", entry("night_remote", src, dst, port, protocol)),
        F.when(pair & (F.col("sessions") > 0), entry("session", src, dst, n="sessions", s1=F.col("session_bytes"), s2=F.col("session_packets"),
                                                     longest=F.col("longest"))),
        F.when(pair, entry("connection", src, dst))))
    each = _vpc_sums(df).select("event_date", F.explode(entries).alias("e")).select("event_date", "e.*")
    summed = each.groupBy("event_date", *KEYS).agg(F.sum("n").alias("n"), _total("s1"), _total("s2"), F.max("longest").alias("longest"))
    times = {c: F.lit(None).cast("timestamp_ntz") for c in ("first_utc", "first_local", "last_utc", "last_local")}
    return summed.withColumns(times).select(*KEYS, *VALUES, "event_date")


def _s3_entries(df: DataFrame) -> tuple[DataFrame, Column]:
    df = s3a.requester_pairs(df).withColumn("__ua", classify_user_agent_coarse("user_agent"))
    counted = F.col("operation").isin(lookups.S3_OBJECT_OPERATIONS) & F.col("key").isNotNull() & F.col("bucket").isNotNull()
    return df, F.array_compact(F.array(
        _entry(DAY), _entry("requester", F.col("requester_arn"), F.col("source_ip")), _entry("ua", F.col("__ua")),
        _entry("operation_name", F.coalesce("operation", F.lit(""))),
        F.when(counted, _entry("operation", F.col("operation"), F.col("bucket"), F.col("key")))))


def event_states(df: DataFrame, log_type: str, user_field: str | list[str] = "user_name") -> DataFrame:
    """Parsed events -> their states by event date (``SCHEMA``)."""
    if log_type == "vpc":
        return _vpc_states(df)
    named, entries = {"cloudtrail": lambda: _cloudtrail_entries(df, user_field), "s3": lambda: _s3_entries(df)}[log_type]()
    each = named.select(F.to_date(TIME_COLUMN[log_type]).alias("event_date"), F.explode(entries).alias("e")).select("event_date", "e.*")
    return each.groupBy("event_date", *KEYS).agg(
        F.count(F.lit(1)).alias("n"), sum0("s1").alias("s1"), sum0("s2").alias("s2"), F.max("longest").alias("longest"),
        F.min("utc").alias("first_utc"), F.min("local").alias("first_local"), F.max("utc").alias("last_utc"),
        F.max("local").alias("last_local")).select(*KEYS, *VALUES, "event_date")


def _total(c: str) -> Column:
    """A sum of sums; one that is beyond bigint (NULL) makes it NULL."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.try_sum(c)).alias(c)


def merged_states(states: DataFrame) -> DataFrame:
    """States of days -> states of the whole time; a sum that is beyond bigint (NULL) stays so."""
    return states.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), _total("s1"), _total("s2"), F.max("longest").alias("longest"), F.min("first_utc").alias("first_utc"),
        F.min("first_local").alias("first_local"), F.max("last_utc").alias("last_utc"), F.max("last_local").alias("last_local"))


def _of(states: DataFrame, dim: str, *names: str) -> DataFrame:
    """One dimension, its keys under the names given."""
    keys = [F.col(f"k{i}").alias(n) for i, n in enumerate(names, 1)]
    return states.where(F.col("dim") == dim).select(*keys, *VALUES)


def _cloudtrail_tables(states: DataFrame, lookup: DataFrame | None, top_n: int) -> dict[str, DataFrame]:
    counts = ct.Counts(states.select(F.col("dim").alias("dimension"), F.col("k1").alias("value"), "n"))
    ips = _of(states, "ip", "ip").select("ip", F.col("n").alias("access_count"), F.col("first_utc").alias("fu"),
                                         F.col("first_local").alias("fl"), F.col("last_utc").alias("lu"), F.col("last_local").alias("ll"))
    night = _of(states, "night_ip", "ip").select("ip", F.col("n").alias("access_count"))
    failed = _of(states, "failed", "category", "dimension", "value").select("category", "dimension", "value", F.col("n").alias("count"))
    return {
        "Access_IP_Statistics_(Top_20)": ct.rank_ips(ips, top_n),
        "Nightshift_IP_Statistics": ct.top_n(night, "access_count", None, ["ip"]),
        "Nightshift_EventName_Statistics": ct._frequency(counts, "night_event", "event_name", "nightshift_event_count", "event_pct"),
        "EventName_Statistics": ct.ct_event_names(counts), "UserAgent_Statistics": ct.ct_user_agents(counts),
        "Failed_Auth_Statistics": ct.failed_auth_table(failed), "Region_Statistics": ct.ct_regions(counts),
        "Mitre_ATTACK_Tactics": ct.ct_tactics(counts, lookup),
    }


def _vpc_tables(states: DataFrame, top_n: int) -> dict[str, DataFrame]:
    sums = [F.col("s1").alias("total_bytes"), F.col("s2").alias("total_packets")]
    number = [F.col(c).cast("bigint").alias(c) for c in ("dstport", "protocol")]
    remote = _of(states, "night_remote", "srcaddr", "dstaddr", "dstport", "protocol").select("srcaddr", "dstaddr", *number, *sums)
    service = port_service_lookup(states.sparkSession)
    return {
        "Access_IP_Statistics_(Top_20)": vpca.rank_ips(_of(states, "ip", "ip", "type").select("ip", sums[0], "type", sums[1]), top_n),
        "Port_Protocol_Statistics": vpca.rank_ports(_of(states, "port", "dstport", "protocol").select(
            *number, F.col("n").alias("flow_count"), sums[0]), top_n),
        "Nightshift_Remote_Access_Events": vpca.rank_night_remote(remote.join(service, remote["dstport"] == service["port"]).drop("port")),
        "Session_Duration_Statistics": vpca.rank_sessions(_of(states, "session", "srcaddr", "dstaddr").select(
            "srcaddr", "dstaddr", F.col("longest").alias("duration_seconds"), *sums), top_n),
        "Connection_Statistics_(Top_20)": vpca.rank_connections(_of(states, "connection", "srcaddr", "dstaddr").select(
            "srcaddr", "dstaddr", *sums, F.col("n").alias("flow_count")), top_n),
    }


def _s3_tables(states: DataFrame, lookup: DataFrame | None, top_n: int) -> dict[str, DataFrame]:
    lookup = tactic_lookup(states.sparkSession, "s3_access_log") if lookup is None else lookup
    return {
        "Access_IP_Statistics_(Top_20)": s3a.rank_requesters(_of(states, "requester", "requester_arn", "source_ip").select(
            "requester_arn", "source_ip", F.col("n").alias("request_count")), top_n),
        "Operation_Statistics": s3a.rank_operations(_of(states, "operation", "operation", "bucket", "k").select(
            "operation", "bucket", "k", F.col("n").alias("count")), top_n),
        "UserAgent_Statistics": s3a.rank_user_agents(_of(states, "ua", "user_agent_type").select(
            "user_agent_type", F.col("n").alias("usage_count")), top_n),
        "Mitre_ATTACK_Tactics": s3a.tactic_hits(_of(states, "operation_name", "operation").select(
            "operation", F.col("n").alias("hit_count")), lookup),
    }


def ranked_tables(states: DataFrame, log_type: str, lookup: DataFrame | None = None, top_n: int = 20) -> dict[str, DataFrame]:
    """The ranked tables of a bundle from merged states (a staged or landed table: every table filters its dimension)."""
    return {"cloudtrail": lambda: _cloudtrail_tables(states, lookup, top_n), "vpc": lambda: _vpc_tables(states, top_n),
            "s3": lambda: _s3_tables(states, lookup, top_n)}[log_type]()


# ---------------------------------------------------------------------------
# by increments
# ---------------------------------------------------------------------------

def update_states(events: DataFrame, path: str, log_type: str, days: Iterable[str] | None = None,
                  user_field: str | list[str] = "user_name") -> None:
    """Put the states of whole days into the table at ``path``, replacing those days.

    ``events`` are the parsed events of the days, or a landed table that has
    them (``event_date`` prunes its partitions).  ``days`` names them (``yyyy-MM-dd``); a
    named day without events replaces what was there with none.  Without ``days``
    every date found in ``events`` is replaced, events without a time included.
    """
    spark = events.sparkSession
    if days is not None:
        days = list(days)
        date = F.col("event_date") if "event_date" in events.columns else F.to_date(TIME_COLUMN[log_type])
        events = events.where(date.isin([F.lit(d).cast("date") for d in days]))
    states = event_states(events, log_type, user_field)
    if days:
        marks = spark.createDataFrame([(d,) for d in days], "day string")
        empty = [F.lit(None).cast(t).alias(c) for c, t in states.dtypes if c not in ("dim", "n", "event_date")]
        marks = marks.select(F.lit(DAY).alias("dim"), F.lit(0).cast("bigint").alias("n"), F.col("day").cast("date").alias("event_date"), *empty)
        states = states.unionByName(marks)
    # a day's states are sorted by dimension, so a reader of one dimension skips the row groups of the others
    (states.hint("rebalance", "event_date").sortWithinPartitions("event_date", "dim", "k1").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path))


def read_states(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """The merged states of the days from ``first_day`` to ``last_day`` (default: all)."""
    try:
        states = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        states = spark.createDataFrame([], SCHEMA)
    if first_day is not None:
        states = states.where(F.col("event_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        states = states.where(F.col("event_date") <= F.lit(last_day).cast("date"))
    return merged_states(states)


def state_days(spark: SparkSession, path: str) -> DataFrame:
    """``(event_date, events)`` of every day that was delivered."""
    states = spark.read.schema(SCHEMA).parquet(path).where(F.col("dim") == DAY)
    return states.groupBy("event_date").agg(F.sum("n").alias("events"))
