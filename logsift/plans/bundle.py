"""Analysis bundles and sinks.

``run_analysis`` maps a parsed table to the full catalogue of result tables of
its log type (lazy DataFrames, named like the original report sheets);
``write_bundle`` writes them, ``run_summary`` reports per-type status and
counts, ``write_parsed`` lands a parsed table as date-partitioned Parquet and
``export_ordered`` writes the original tool's CSV column layout.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import HOUR_COLUMN, last_days, parse_naive
from ..functions.common import top_n as ranked
from ..operators import cloudtrail as ct
from ..operators import report as rpt
from ..operators import s3 as s3a
from ..operators.enrich import tactic_lookup
from ..schemas import EXPORT_LAST, EXPORT_PRIORITY, IDENTITY_KEYS, IDENTITY_PREFIX, export_names
from ..session import materialize
from .states import TIME_COLUMN, event_states, merged_states, ranked_tables

# ---------------------------------------------------------------------------
# FIXED VALUES: result table names of the original report workbooks, in order
# ---------------------------------------------------------------------------
CLOUDTRAIL_TABLES = [
    "Access_IP_Statistics_(Top_20)", "Nightshift_IP_Statistics", "Nightshift_EventName_Statistics",
    "EventName_Statistics", "UserAgent_Statistics", "Failed_Auth_Statistics", "Region_Statistics",
    "ConsoleLogin_Statistics", "CreateUser_Statistics", "Mitre_ATTACK_Tactics", "Mitre_ATTACK_Events",
]
VPC_TABLES = [
    "Access_IP_Statistics_(Top_20)", "Port_Protocol_Statistics", "Nightshift_Remote_Access_Events",
    "Session_Duration_Statistics", "Connection_Statistics_(Top_20)",
]
S3_TABLES = [
    "Access_IP_Statistics_(Top_20)", "Operation_Statistics", "UserAgent_Statistics", "Mitre_ATTACK_Tactics",
    "Mitre_ATTACK_Events",
]
# ---------------------------------------------------------------------------


def cloudtrail_listing(df: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """The events that some row-level table shows: mapped to a tactic, failed, console logins, created users."""
    known = (tactic_lookup(df.sparkSession, "cloudtrail") if lookup is None else lookup).select("name").distinct()
    known = known.select(F.col("name").alias("__name"), F.lit(True).alias("__mapped"))
    if lookup is None:
        known = F.broadcast(known)                      # the packaged table: at most 175 names
    tagged = ct._with_failure_text(df).join(known, F.col("event_name") == F.col("__name"), "left")
    shown = F.coalesce(F.col("__mapped"), F.col("event_name").isin("ConsoleLogin", "CreateUser"), F.lit(False))
    return tagged.where(shown | (F.size(ct._failure_categories()) > 0)).select(*df.columns)


def cloudtrail_bundle(df: DataFrame, as_of: str | None = None, lookup: DataFrame | None = None,
                      top_n: int = 20, user_field: str | list[str] = "user_name") -> dict[str, DataFrame]:
    """Tables of the CloudTrail report from two passes over the events, both staged in the shared
    checkpoint folder: the states that all ranked tables read, and the events that row-level tables show."""
    states = materialize(merged_states(event_states(df, "cloudtrail", user_field)), "table")
    shown = materialize(cloudtrail_listing(df, lookup), "table")
    tables = ranked_tables(states, "cloudtrail", lookup, top_n) | {
        "ConsoleLogin_Statistics": ct.ct_console_login(shown), "CreateUser_Statistics": ct.ct_create_user(shown),
        "Mitre_ATTACK_Events": ct.ct_tactic_events(shown, lookup, sort=False),
    }
    out = {name: tables[name] for name in CLOUDTRAIL_TABLES}
    out["Failed_Auth_Events"] = ct.failed_auth_events(shown)
    return out | _derived("cloudtrail", out, as_of)


def vpc_bundle(df: DataFrame, top_n: int = 20) -> dict[str, DataFrame]:
    """Tables of the VPC report from one pass over the flows."""
    states = materialize(merged_states(event_states(df, "vpc")), "table")
    out = ranked_tables(states, "vpc", top_n=top_n)
    return out | _derived("vpc", out)


def s3_bundle(df: DataFrame, lookup: DataFrame | None = None, top_n: int = 20) -> dict[str, DataFrame]:
    """Tables of the S3 report: the ranked ones from one pass, the tagged requests from another."""
    states = materialize(merged_states(event_states(df, "s3")), "table")
    tables = ranked_tables(states, "s3", lookup, top_n)
    out = {name: tables[name] if name in tables else s3a.s3_tactic_events(df, lookup, sort=False) for name in S3_TABLES}
    return out | _derived("s3", out)


def _recent_logins(logins: DataFrame, as_of: str | None) -> DataFrame:
    return rpt.login_status_counts(logins.filter(last_days(parse_naive("event_time_utc"), 30, as_of)))


# chart series: name -> (the table it is made from, how); ``write_bundle`` makes them from the written table
DERIVED = {
    "cloudtrail": {
        "Report_Login_Status_30d": ("ConsoleLogin_Statistics", _recent_logins),
        "Report_Top_Creators": ("CreateUser_Statistics", lambda t, _: rpt.top_creators(t)),
        "Report_Tactic_Totals": ("Mitre_ATTACK_Tactics", lambda t, _: rpt.tactic_totals(t)),
        "Report_User_Agents": ("UserAgent_Statistics", lambda t, _: ranked(t, "usage_count", 8, ["user_agent_type"])),
    },
    "vpc": {
        "Report_Session_Hours": ("Session_Duration_Statistics", lambda t, _: rpt.session_hours(t)),
        "Report_Connections": ("Connection_Statistics_(Top_20)",
                               lambda t, _: rpt.connection_labels(ranked(t, "total_bytes", 10, ["source_ip", "destination_ip"], sums=True))),
        "Report_Ports": ("Port_Protocol_Statistics",
                         lambda t, _: rpt.port_labels(ranked(t, "total_bytes", 10, ["port", "protocol"], sums=True))),
    },
    "s3": {
        "Report_Requesters": ("Access_IP_Statistics_(Top_20)",
                              lambda t, _: rpt.requester_labels(ranked(t, "request_count", 10, ["requester_arn", "source_ip"]))),
        "Report_Operations": ("Operation_Statistics",
                              lambda t, _: rpt.operation_labels(ranked(t, "count", 10, ["operation", "bucket", "prefix"]))),
        "Report_User_Agents": ("UserAgent_Statistics",
                               lambda t, _: rpt.user_agent_labels(ranked(t, "usage_count", 10, ["user_agent_type"]))),
        "Report_Event_Preview": ("Mitre_ATTACK_Events",
                                 lambda t, _: rpt.s3_event_preview(t.orderBy(F.col("request_datetime").asc_nulls_last(),
                                                                             F.col("request_id").asc_nulls_last()))),
    },
}


def _derived(log_type: str, tables: Mapping[str, DataFrame], as_of: str | None = None) -> dict[str, DataFrame]:
    return {name: make(tables[source], as_of) for name, (source, make) in DERIVED[log_type].items()}


def run_analysis(df: DataFrame, log_type: str, as_of: str | None = None, lookup: DataFrame | None = None,
                 materialization: str | None = None, top_n: int = 20,
                 user_field: str | list[str] = "user_name") -> dict[str, DataFrame]:
    """All result tables for one parsed table, as lazy DataFrames.

    Give it a landed table (:func:`write_parsed`): it is scanned once for the
    states of all ranked tables (:mod:`.states`) and, but for VPC, once for the row-level
    tables; both passes run here.  ``materialization='checkpoint'`` cuts the
    lineage of any other frame into the shared checkpoint folder first;
    ``'persist'`` caches it, for small frames.
    """
    base = materialize(df, materialization)
    if log_type == "cloudtrail":
        return cloudtrail_bundle(base, as_of, lookup, top_n, user_field)
    if log_type == "vpc":
        return vpc_bundle(base, top_n)
    if log_type == "s3":
        return s3_bundle(base, lookup, top_n)
    raise ValueError(f"unknown log type {log_type!r}")


def _safe_name(name: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "_-" else "_" for ch in name)


def _csv_safe(df: DataFrame) -> DataFrame:
    """Nested values (maps, arrays, structs) as JSON text so the table fits CSV."""
    return df.select([F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c)
                      for c, t in df.dtypes])


def write_bundle(tables: Mapping[str, DataFrame], path: str, log_type: str, fmt: str = "parquet",
                 mode: str = "overwrite", rebalance: bool = True, as_of: str | None = None) -> dict[str, str]:
    """Write each table under ``path/<log_type>/<table>/``.

    Chart series (``DERIVED``) are made from the table they summarise as it was
    written just before (Parquet), not by another pass over the events.

    Row-level listings (tagged events) are as large as the input: they are
    written partitioned by tactic, sorted by (tactic, time) within each task,
    never globally sorted.  Every scan task holds events of every tactic, so a
    plain partitioned write leaves (tasks x tactics) small files.  With
    ``rebalance`` (default) the listing goes through one ``REBALANCE`` shuffle
    on tactic: AQE splits a hot tactic (one may hold a third of all events)
    into advisory-sized tasks and merges small ones, giving files of about
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``.  Without AQE the hint
    is ignored.  Returns name -> location.
    """
    written = {}
    for name, df in tables.items():
        loc = f"{path.rstrip('/')}/{log_type}/{_safe_name(name)}"
        partition_by = []
        source, make = DERIVED.get(log_type, {}).get(name, (None, None))
        if source in written and fmt == "parquet":
            df = make(df.sparkSession.read.schema(tables[source].schema).parquet(written[source]), as_of)
        if fmt == "csv":
            df = _csv_safe(df)
        if name == "Mitre_ATTACK_Events" and "tactic" in df.columns:
            keys = ["tactic"] + ([TIME_COLUMN[log_type]] if TIME_COLUMN[log_type] in df.columns else [])
            if rebalance:
                df = df.hint("rebalance", "tactic")
            df = df.sortWithinPartitions(*keys)
            partition_by = ["tactic"]
        w = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            w = w.option("header", "true")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(loc)
        written[name] = loc
    return written


def run_summary(spark: SparkSession, parsed: Mapping[str, DataFrame | None]) -> DataFrame:
    """Per log type: status and number of parsed events; one union of global counts.

    ``parsed`` maps log type -> parsed DataFrame (``None`` = skipped).  A type
    with no events is ``no data``.
    """
    parts = []
    for log_type, df in parsed.items():
        if df is None:
            parts.append(spark.createDataFrame([(log_type, "skipped", 0)],
                                               "log_type string, status string, parsed_events bigint"))
            continue
        parts.append(df.agg(F.count(F.lit(1)).alias("parsed_events")).select(
            F.lit(log_type).alias("log_type"),
            F.when(F.col("parsed_events") > 0, F.lit("ok")).otherwise(F.lit("no data")).alias("status"),
            "parsed_events"))
    if not parts:
        return spark.createDataFrame([], "log_type string, status string, parsed_events bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_event_date(df: DataFrame, log_type: str) -> DataFrame:
    return df.withColumn("event_date", F.to_date(TIME_COLUMN[log_type]))


# the hour that night filters test, by log type, and the columns that point lookups ask for
NIGHT_TIME = {"cloudtrail": "event_time_local", "vpc": "window_start"}
POINT_COLUMNS = {"cloudtrail": ["source_ip_address", "event_id", "user_name"], "vpc": ["srcaddr", "dstaddr"],
                 "s3": ["remote_ip", "requester", "request_id"]}


def write_parsed(df: DataFrame, path: str, log_type: str, mode: str = "overwrite",
                 partition_by_date: bool = True, max_records_per_file: int = 5_000_000,
                 rebalance: bool = True, bloom: bool = True, options: Mapping[str, str] | None = None) -> None:
    """Land a parsed table as Parquet, partitioned by event date (not by region or
    account: those are skewed).  Readers then get partition pruning on dates.

    One AQE ``REBALANCE`` shuffle on the date bounds the number of files: a busy
    day is split into advisory-sized tasks (never one task per day) and small
    days are merged.  For delivery trees laid out by date, ``rebalance=False``
    saves that shuffle: each task sorts its own rows by date and writes one
    file per date it holds.

    Within a date, rows are sorted by the hour that night filters test, landed as
    ``night_hour``: row groups and pages hold few hours each, and a night filter
    reads those of the night.  ``bloom`` puts Bloom filters on ``POINT_COLUMNS``, so a
    lookup of an address or an event reads the row groups that may have it.
    ``options`` are passed to the Parquet writer.
    """
    hour = NIGHT_TIME.get(log_type)
    if hour in df.columns:
        df = df.withColumn(HOUR_COLUMN, F.hour(hour))
    by_hour = [HOUR_COLUMN] if hour in df.columns else []
    if partition_by_date:
        dated = with_event_date(df, log_type)
        if rebalance:
            dated = dated.hint("rebalance", "event_date")
        w = dated.sortWithinPartitions("event_date", *by_hour).write.partitionBy("event_date")
    else:
        w = (df.sortWithinPartitions(*by_hour) if by_hour else df).write
    if bloom:
        for c in POINT_COLUMNS[log_type]:
            if c in df.columns:
                w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    for k, v in (options or {}).items():
        w = w.option(k, v)
    w.mode(mode).option("maxRecordsPerFile", max_records_per_file).parquet(path)


def ordered_columns(columns: list[str], log_type: str) -> list[str]:
    """Original export order: priority columns, (CloudTrail: ``userIdentity.*`` A-Z),
    the rest A-Z, ``sourceFile`` last."""
    remaining = set(columns)
    ordered = []
    priority = list(EXPORT_PRIORITY[log_type])
    if log_type == "cloudtrail":
        priority += sorted(c for c in columns if c.startswith(IDENTITY_PREFIX))
    for c in priority:
        if c in remaining:
            ordered.append(c)
            remaining.discard(c)
    tail = [EXPORT_LAST] if EXPORT_LAST in remaining else []
    remaining.discard(EXPORT_LAST)
    return ordered + sorted(remaining) + tail


def export_frame(df: DataFrame, log_type: str, identity_keys: list[str] = IDENTITY_KEYS) -> DataFrame:
    """A parsed table in the original CSV layout: original column names, times as text, NULL as ``''``.

    ``identity_keys`` (default: the documented elements) become ``userIdentity.<key>``
    columns; any other key of an identity is kept as JSON in ``userIdentity``.
    """
    names = export_names(log_type)
    cols = []
    for c, t in df.dtypes:
        if c == "user_identity":
            continue
        if c not in names:
            continue
        if t.startswith("timestamp"):
            v = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        else:
            v = F.col(c).cast("string")
        cols.append(v.alias(names[c]))
    if log_type == "cloudtrail" and "user_identity" in df.columns:
        cols += [F.try_element_at("user_identity", F.lit(k)).alias(IDENTITY_PREFIX + k) for k in identity_keys]
        others = F.map_filter("user_identity", lambda k, v: ~k.isin(identity_keys))
        cols.append(F.when(F.size(others) > 0, F.to_json(others)).alias("userIdentity"))
    out = df.select(*cols)
    out = out.select(*[F.col(f"`{c}`") for c in ordered_columns(out.columns, log_type)])
    return out.na.fill("")


def export_ordered(df: DataFrame, log_type: str, path: str, mode: str = "overwrite") -> None:
    """Write :func:`export_frame` as CSV with a header."""
    export_frame(df, log_type).write.mode(mode).option("header", "true").csv(path)
