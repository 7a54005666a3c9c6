"""

``entry`` runs the flagship analysis on sf0.001.  ``queries`` maps each
implemented operator to a callable ``(spark, sf_dir) -> DataFrame`` that runs
the library on log-shaped data derived from the benchmark tables (see
``logsift.fixtures``: CloudTrail from ``events``, VPC flows from ``lineitem``,
S3 access logs from ``orders``; whole tables, every row).  Parser queries
render the rows back to raw log text first and parse it with the real
sources.  ``oracle_sql`` gives the DuckDB SQL for each key (``oracles.py``).

Outputs use only string/bigint/double columns; times are formatted
``yyyy-MM-dd HH:mm:ss``.
"""

from __future__ import annotations

import functools
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from logsift import fixtures as fx  # noqa: E402
from logsift.functions.common import fmt_ts, sum0  # noqa: E402
from logsift.operators import cloudtrail as ct  # noqa: E402
from logsift.operators import report as rpt  # noqa: E402
from logsift.operators import s3 as s3a  # noqa: E402
from logsift.operators import topn, vpc  # noqa: E402
from logsift.operators.enrich import read_tactic_file, tactic_lookup  # noqa: E402
from logsift.plans import bundle, states  # noqa: E402
from logsift.session import materialize  # noqa: E402
from logsift.sources.cloudtrail import cloudtrail_rejects, identity_keys, identity_wide, parse_cloudtrail_docs, read_cloudtrail  # noqa: E402
from logsift.sources import manifest  # noqa: E402
from logsift.sources.parsed import load_parsed  # noqa: E402
from logsift.sources.ranges import read_cloudtrail_ranges  # noqa: E402
from logsift.sources.s3 import parse_s3_lines, read_s3_access, s3_rejects, s3_time_offset  # noqa: E402
from logsift.sources.vpc import parse_vpc_lines, read_vpc_flow, vpc_rejects  # noqa: E402

try:                      # the corpus operators are optional; a broken import inside them is an error
    from logsift.llm import queries as llm_queries
except ModuleNotFoundError as absent:
    if not (absent.name or "").startswith("logsift.llm"):
        raise
    llm_queries = None

FLAGSHIP_SF = "/root/testdata/sf0.001"
AS_OF = "2024-01-31 00:00:00"   # fixed reference time for "last N days" queries


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: top VPC connections by bytes over the flow view of sf0.001."""
    return vpc.vpc_top_connections(fx.vpc_frame(spark, FLAGSHIP_SF))


# ---------------------------------------------------------------------------
# parser round trips
# ---------------------------------------------------------------------------

def _vpc_parse(s, d):
    return _vpc_columns(parse_vpc_lines(fx.vpc_raw_lines(s, d)))


def _vpc_columns(p):
    return p.select("version", "account_id", "interface_id", "srcaddr", "dstaddr", "srcport", "dstport", "protocol",
                    "packets", "bytes", fmt_ts("window_start").alias("window_start"),
                    fmt_ts("window_end").alias("window_end"), "action", "flow_log_status", "source_file")


def _s3_parse(s, d):
    return _s3_columns(parse_s3_lines(fx.s3_raw_lines(s, d)))


def _s3_columns(p):
    cols = [c for c in p.columns if c not in ("request_datetime", "http_status_code")]
    return p.select(*cols, fmt_ts("request_datetime").alias("request_datetime"),
                    F.col("http_status_code").cast("bigint").alias("http_status_code"))


def _s3_parse_status(s, d):
    p = parse_s3_lines(fx.s3_raw_lines(s, d))
    return p.groupBy("parse_status").agg(F.count(F.lit(1)).alias("lines"))


def _ct_parse(shape):
    return lambda s, d: _ct_columns(parse_cloudtrail_docs(fx.ct_raw_documents(s, d, shape)))


def _ct_columns(p):
    return p.select(F.col("event_id"), fmt_ts("event_time").alias("event_time"),
                        fmt_ts("event_time_local").alias("event_time_local"), "aws_region", "event_name",
                        "event_source", "source_ip_address", "user_agent", "error_code", "error_message",
                    "user_type", "user_arn", "account_id", "user_name", "request_elements",
                    F.col("read_only").cast("string").alias("read_only"), "event_category", "source_file")


# files: raw text and parsed tables written to the session's shared folder and read back

def _vpc_files(compression):
    return lambda s, d: _vpc_columns(read_vpc_flow(s, fx.landed_text(fx.vpc_raw_lines(s, d), "vpc", compression))).drop("source_file")


def _s3_files(compression):
    return lambda s, d: _s3_columns(read_s3_access(s, fx.landed_text(fx.s3_raw_lines(s, d), "s3", compression))).drop("source_file")


def _ct_files(compression):
    return lambda s, d: _ct_columns(read_cloudtrail(s, fx.landed_json(s, d, compression))).drop("source_file")


def _ct_files_split(s, d):
    """One document of all records, read by byte ranges: some for every core."""
    path, key = fx.landing_folder(s, "document"), "spark.sql.files.maxPartitionBytes"
    fx.single_document(s, d, path)
    before = s.conf.get(key)
    s.conf.set(key, str(1 << 20))
    try:
        return _ct_columns(read_cloudtrail_ranges(s, path)).drop("source_file")
    finally:
        s.conf.set(key, before)


MANIFEST_DAYS = ("2024-01-05", "2024-01-14")


def _ct_files_manifest(s, d):
    """The events delivered on some days: the manifest lists and reads those days' files only."""
    root, table = fx.landed_archive(s, d), fx.landing_folder(s, "manifest")
    manifest.update_manifest(s, root, table, "cloudtrail")
    return _ct_columns(manifest.read_manifest(s, manifest.manifest_files(s, table, *MANIFEST_DAYS), "cloudtrail")).drop("source_file")


def _load(log_type, frame, columns):
    def run(s, d):
        path = fx.landing_folder(s, log_type)
        bundle.write_parsed(frame(s, d), path, log_type)
        return columns(load_parsed(s, path, log_type).drop("event_date")).drop("source_file")
    return run


def _over_landed(log_type, frame, analysis):
    """An analysis over the landed table, whose layout its filters use."""
    def run(s, d):
        path = fx.landing_folder(s, log_type)
        bundle.write_parsed(frame(s, d), path, log_type)
        return analysis(load_parsed(s, path, log_type))
    return run


def _events_of_ip(df):
    e = ct.events_of(df, "source_ip_address", ["10.0.1.13", "10.0.3.7", "192.0.2.1"])
    return e.select("event_id", "source_ip_address", "event_name", fmt_ts("event_time").alias("event_time"))


def _load_vpc_csv(s, d):
    path = fx.landing_folder(s, "vpc-csv")
    bundle.export_ordered(fx.vpc_frame(s, d), "vpc", path)
    return _vpc_columns(load_parsed(s, path, "vpc", fmt="csv")).drop("source_file")


def _ct_rejects(s, d):
    docs = cloudtrail_rejects(fx.ct_raw_documents(s, d, "bad_record")).union(cloudtrail_rejects(fx.ct_raw_documents(s, d, "jsonl")))
    return docs


def _vpc_odd_values(s, d):
    p = parse_vpc_lines(fx.odd_vpc_lines(s, d))
    return p.groupBy("srcaddr").agg(F.count(F.lit(1)).alias("flows"), F.count("window_start").alias("timed"),
                                    F.count("window_end").alias("ended"), sum0("bytes").alias("total_bytes"))


def _bundle(log_type, frame):
    """Every row of every table of a bundle as it was written, its values on one line."""
    def run(s, d):
        tables = bundle.run_analysis(frame(s, d), log_type, as_of=AS_OF)
        written = bundle.write_bundle(tables, fx.landing_folder(s, "bundle"), log_type, as_of=AS_OF)
        parts = []
        for name, path in written.items():
            t = s.read.schema(tables[name].schema).parquet(path)
            text = {c: fmt_ts(c) if kind.startswith("timestamp") else F.col(c).cast("string") for c, kind in t.dtypes if not kind.startswith("map")}
            columns = sorted(oracles.BUNDLE_COLUMNS.get((log_type, name), t.columns))
            line = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), text[c]) for c in columns])
            parts.append(t.select(F.lit(name).alias("table_name"), line.alias("line")))
        return functools.reduce(DataFrame.union, parts)
    return run


def _incremental(log_type, frame, table):
    """A ranked table from states kept by days: three deliveries, the second first with half of its events."""
    def run(s, d):
        events, path = materialize(frame(s, d), "table"), fx.landing_folder(s, "states")     # read once per delivery
        third = F.coalesce(F.dayofmonth(states.TIME_COLUMN[log_type]) % 3, F.lit(0))
        part = [events.where(third == i) for i in range(3)]
        for delivery in (part[0], part[1].where(F.pmod(F.xxhash64(F.struct(*[c for c, t in events.dtypes if not t.startswith("map")])), F.lit(2)) == 0),
                         part[2], part[1]):
            states.update_states(delivery, path, log_type)
        return states.ranked_tables(states.read_states(s, path), log_type)[table]
    return run


def _in_order(df):
    """An ordered result with its position, so that the order is compared too."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))


def _ct_identity_wide(s, d):
    p = parse_cloudtrail_docs(fx.ct_raw_documents(s, d, "records"))
    w = identity_wide(p.select("event_id", "user_identity"), ["type", "arn", "accountId", "userName", "sessionContext"])
    return w.drop("user_identity")


def _ct_local_time(s, d):
    f = fx.ct_frame(s, d)
    return f.select(F.col("event_id"), "aws_region", fmt_ts("event_time").alias("event_time"),
                    fmt_ts("event_time_local").alias("event_time_local"))


# ---------------------------------------------------------------------------
# analyses
# ---------------------------------------------------------------------------

def _ct_failed_events(s, d):
    e = ct.failed_auth_events(fx.ct_frame(s, d))
    return e.select("category", "failure_time", "failure_ip", "failure_user", "failure_account", "failure_type",
                    "failure_message", "event_name", "event_id")


def _ct_tactic_events(s, d):
    e = ct.ct_tactic_events(fx.ct_frame(s, d))
    return e.select("tactic", "event_id", "event_name", fmt_ts("event_time").alias("event_time"),
                    "source_ip_address", "aws_region")


def _s3_tactic_events(s, d):
    e = s3a.s3_tactic_events(fx.s3_frame(s, d))
    return e.select("tactic", "request_id", "operation", "bucket", "key", "remote_ip", "requester",
                    fmt_ts("request_datetime").alias("request_datetime"), "user_agent", "bytes_sent")


def _rpt_session_hours(s, d):
    return rpt.session_hours(vpc.vpc_session_duration(fx.vpc_frame(s, d)))


def _run_summary(s, d):
    return bundle.run_summary(s, {"cloudtrail": fx.ct_frame(s, d), "vpc": fx.vpc_frame(s, d),
                                  "s3": fx.s3_frame(s, d)})


def _export_vpc(s, d):
    return bundle.export_frame(fx.vpc_frame(s, d), "vpc")


def _export(log_type, frame):
    """The rows of the ordered export beside its column order."""
    def run(s, d):
        out = bundle.export_frame(frame(s, d), log_type)
        return out.withColumn("column_order", F.lit("|".join(out.columns)))
    return run


def _load_ct_csv(s, d):
    """CloudTrail in the original CSV layout, with a column for every key that the identities have."""
    path, parsed = fx.landing_folder(s, "ct-csv"), materialize(_ct_parsed(s, d), "table")     # two passes read it
    keys = sorted(r.key for r in identity_keys(parsed).collect())       # distinct keys of a record element
    bundle.export_frame(parsed, "cloudtrail", keys).write.option("header", "true").option("escape", '"').csv(path)
    return _ct_columns(load_parsed(s, path, "cloudtrail", fmt="csv")).drop("source_file")


def _load_s3_csv(legacy):
    """S3 in the original CSV layout; ``legacy`` has the bracketed time in ``request_datetime``."""
    def run(s, d):
        path = fx.landing_folder(s, "s3-csv")
        out = bundle.export_frame(_s3_parsed(s, d), "s3")
        if legacy:
            out = out.withColumn("request_datetime", F.col("original_timestamp")).drop("request_datetime_(UTC+0)")
        out.write.option("header", "true").option("escape", '"').csv(path)
        return _s3_columns(load_parsed(s, path, "s3", fmt="csv")).drop("source_file")
    return run


TACTIC_FILE = {"cloudtrail": {"Alpha": ["GetObject", "ListUsers"], "Beta": ["ListUsers", "CreateUser", "NoSuchEvent"], "Gamma": ["ListUsers"]}}


def _ct_tactics_file(s, d):
    """Hits by the tactics of a user's file, under every policy for names listed twice."""
    path, events = fx.landing_folder(s, "tactics"), fx.ct_frame(s, d)
    s.createDataFrame([(json.dumps(TACTIC_FILE),)], "value string").coalesce(1).write.text(path)
    config = read_tactic_file(s, path)
    parts = [ct.ct_tactics(events, tactic_lookup(s, "cloudtrail", config, policy)).withColumn("policy", F.lit(policy)) for policy in ("first", "last", "all")]
    return functools.reduce(DataFrame.union, parts)


def _ct_files_lineage(s, d):
    """Which file every event came from."""
    return read_cloudtrail(s, fx.landed_archive(s, d), columns=["event_id"]).select("event_id", "source_file")


def _s3_time_offsets(s, d):
    lines = fx.view(s, d, "s3")
    return lines.select("request_id", "original_timestamp", s3_time_offset("original_timestamp").alias("time_offset"))


# end to end: raw log text -> parser -> analysis (same results as on the typed views)

def _vpc_parsed(s, d):
    return parse_vpc_lines(fx.vpc_raw_lines(s, d))


def _s3_parsed(s, d):
    return parse_s3_lines(fx.s3_raw_lines(s, d))


def _ct_parsed(s, d):
    return parse_cloudtrail_docs(fx.ct_raw_documents(s, d, "records"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ctf, vpcf, s3f = fx.ct_frame, fx.vpc_frame, fx.s3_frame
    found = {
        # sources / parsers
        "vpc_parse_lines": _vpc_parse,
        "s3_parse_lines": _s3_parse,
        "s3_parse_status": _s3_parse_status,
        "ct_parse_records": _ct_parse("records"),
        "ct_parse_jsonl": _ct_parse("jsonl"),
        "ct_parse_array": _ct_parse("array"),
        "ct_parse_single": _ct_parse("single"),
        "ct_parse_dupkeys": _ct_parse("dupkeys"),
        "ct_parse_bad_record": _ct_parse("bad_record"),
        "vpc_rejects": lambda s, d: vpc_rejects(fx.vpc_raw_lines(s, d)),
        "s3_rejects": lambda s, d: s3_rejects(fx.s3_raw_lines(s, d)),
        "ct_rejects": _ct_rejects,
        "vpc_odd_values": _vpc_odd_values,
        "vpc_files": _vpc_files("none"),
        "vpc_files_gzip": _vpc_files("gzip"),
        "s3_files": _s3_files("none"),
        "s3_files_gzip": _s3_files("gzip"),
        "ct_files": _ct_files("none"),
        "ct_files_gzip": _ct_files("gzip"),
        "ct_files_manifest": _ct_files_manifest,
        "ct_files_split": _ct_files_split,
        "load_vpc": _load("vpc", fx.vpc_frame, _vpc_columns),
        "load_vpc_csv": _load_vpc_csv,
        "load_cloudtrail_csv": _load_ct_csv,
        "load_s3_csv": _load_s3_csv(False),
        "load_s3_csv_legacy": _load_s3_csv(True),
        "ct_files_lineage": _ct_files_lineage,
        "s3_time_offsets": _s3_time_offsets,
        "ct_identity_keys": lambda s, d: identity_keys(_ct_parsed(s, d)),
        "load_s3": _load("s3", _s3_parsed, _s3_columns),
        "load_cloudtrail": _load("cloudtrail", _ct_parsed, _ct_columns),
        "ct_identity_wide": _ct_identity_wide,
        "ct_local_time": _ct_local_time,
        # VPC flow analyses
        "vpc_top_ips": lambda s, d: vpc.vpc_top_ips(vpcf(s, d)),
        "vpc_top_ports": lambda s, d: vpc.vpc_top_ports(vpcf(s, d)),
        "vpc_night_remote": lambda s, d: vpc.vpc_night_remote(vpcf(s, d)),
        "vpc_session_duration": lambda s, d: vpc.vpc_session_duration(vpcf(s, d)),
        "vpc_top_connections": lambda s, d: vpc.vpc_top_connections(vpcf(s, d)),
        "vpc_top_connections_joined": lambda s, d: vpc.vpc_top_connections_joined(vpcf(s, d)),
        "vpc_top_connections_tput": lambda s, d: topn.vpc_top_connections_tput(fx.spread(vpcf(s, d))),
        "vpc_top_ips_tput": lambda s, d: topn.vpc_top_ips_tput(fx.spread(vpcf(s, d))),
        "ct_top_ips_tput": lambda s, d: topn.ct_top_ips_tput(fx.spread(ctf(s, d))),
        "s3_requesters_tput": lambda s, d: topn.s3_requesters_tput(fx.spread(s3f(s, d))),
        # over landed tables: night hours and point lookups pruned by the files' statistics
        "ct_night_ips_landed": _over_landed("cloudtrail", ctf, ct.ct_night_ips),
        "ct_night_events_landed": _over_landed("cloudtrail", ctf, ct.ct_night_events),
        "vpc_night_remote_landed": _over_landed("vpc", vpcf, vpc.vpc_night_remote),
        "ct_events_of_ip": _over_landed("cloudtrail", ctf, _events_of_ip),
        # states kept by days
        "ct_top_ips_incremental": _incremental("cloudtrail", ctf, "Access_IP_Statistics_(Top_20)"),
        "ct_tactics_incremental": _incremental("cloudtrail", ctf, "Mitre_ATTACK_Tactics"),
        "vpc_top_connections_incremental": _incremental("vpc", vpcf, "Connection_Statistics_(Top_20)"),
        "s3_operations_incremental": _incremental("s3", s3f, "Operation_Statistics"),
        # S3 access analyses
        "s3_requesters": lambda s, d: s3a.s3_requesters(s3f(s, d)),
        "s3_operations": lambda s, d: s3a.s3_operations(s3f(s, d)),
        "s3_user_agents": lambda s, d: s3a.s3_user_agents(s3f(s, d)),
        "s3_tactics": lambda s, d: s3a.s3_tactics(s3f(s, d)),
        "s3_tactic_events": _s3_tactic_events,
        # CloudTrail analyses
        "ct_top_ips": lambda s, d: ct.ct_top_ips(ctf(s, d)),
        "ct_night_ips": lambda s, d: ct.ct_night_ips(ctf(s, d)),
        "ct_night_events": lambda s, d: ct.ct_night_events(ctf(s, d)),
        "ct_event_names": lambda s, d: ct.ct_event_names(ctf(s, d)),
        "ct_user_agents": lambda s, d: ct.ct_user_agents(ctf(s, d)),
        "ct_failed_auth": lambda s, d: ct.ct_failed_auth(ctf(s, d)),
        "ct_failed_details": lambda s, d: ct.failed_auth_details(ctf(s, d)),
        "ct_failed_events": _ct_failed_events,
        "ct_event_names_ordered": lambda s, d: _in_order(ct.ct_event_names(ctf(s, d))),
        "ct_tactics_ordered": lambda s, d: _in_order(ct.ct_tactics(ctf(s, d))),
        "ct_regions": lambda s, d: ct.ct_regions(ctf(s, d)),
        "ct_console_login": lambda s, d: ct.ct_console_login(ctf(s, d)),
        "ct_console_login_recent": lambda s, d: ct.ct_console_login(ctf(s, d), days=10, as_of=AS_OF),
        "ct_create_user": lambda s, d: ct.ct_create_user(ctf(s, d)),
        "ct_tactics": lambda s, d: ct.ct_tactics(ctf(s, d)),
        "ct_tactic_events": _ct_tactic_events,
        "ct_tactics_file": _ct_tactics_file,
        "ct_failed_preview": lambda s, d: ct.failed_auth_preview(ctf(s, d)),
        # report series
        "rpt_login_status": lambda s, d: rpt.login_status_counts(ct.ct_console_login(ctf(s, d), days=30, as_of=AS_OF)),
        "rpt_creators": lambda s, d: rpt.top_creators(ct.ct_create_user(ctf(s, d))),
        "rpt_tactic_totals": lambda s, d: rpt.tactic_totals(ct.ct_tactics(ctf(s, d))),
        "rpt_ua_top8": lambda s, d: rpt.head(ct.ct_user_agents(ctf(s, d)), 8),
        "rpt_session_hours": _rpt_session_hours,
        "rpt_connection_labels": lambda s, d: rpt.connection_labels(vpc.vpc_top_connections(vpcf(s, d), 10)),
        "rpt_port_labels": lambda s, d: rpt.port_labels(vpc.vpc_top_ports(vpcf(s, d), 10)),
        "rpt_requester_labels": lambda s, d: rpt.requester_labels(s3a.s3_requesters(s3f(s, d), 10)),
        "rpt_operation_labels": lambda s, d: rpt.operation_labels(s3a.s3_operations(s3f(s, d), 10)),
        "rpt_ua_labels": lambda s, d: rpt.user_agent_labels(s3a.s3_user_agents(s3f(s, d), 10)),
        "rpt_s3_event_preview": lambda s, d: rpt.s3_event_preview(s3a.s3_tactic_events(s3f(s, d), sort=True)),
        # end to end (raw text -> parsed -> report)
        "vpc_pipeline_top_connections": lambda s, d: vpc.vpc_top_connections(_vpc_parsed(s, d)),
        "vpc_pipeline_night_remote": lambda s, d: vpc.vpc_night_remote(_vpc_parsed(s, d)),
        "s3_pipeline_requesters": lambda s, d: s3a.s3_requesters(_s3_parsed(s, d)),
        "s3_pipeline_tactics": lambda s, d: s3a.s3_tactics(_s3_parsed(s, d)),
        "ct_pipeline_failed_auth": lambda s, d: ct.ct_failed_auth(_ct_parsed(s, d)),
        "ct_pipeline_night_events": lambda s, d: ct.ct_night_events(_ct_parsed(s, d)),
        # sinks
        "run_summary": _run_summary,
        "export_column_order": _export_vpc,
        "export_cloudtrail": _export("cloudtrail", ctf),
        "export_s3": _export("s3", s3f),
        "bundle_cloudtrail": _bundle("cloudtrail", ctf),
        "bundle_vpc": _bundle("vpc", vpcf),
        "bundle_s3": _bundle("s3", s3f),
    }
    return found | (llm_queries.queries() if llm_queries else {})


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | (llm_queries.oracle_sql() if llm_queries else {})
