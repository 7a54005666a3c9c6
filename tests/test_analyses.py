"""Analyses on hand-made parsed tables: ties, NULL keys, empty inputs, categories."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logsift.operators import cloudtrail as ct
from logsift.operators import s3 as s3a
from logsift.operators import vpc
from logsift.schemas import CLOUDTRAIL_SCHEMA, S3_SCHEMA, VPC_SCHEMA


def _vpc(spark, rows):
    cols = ["srcaddr", "dstaddr", "dstport", "protocol", "packets", "bytes", "window_start", "window_end"]
    base = {f.name: None for f in VPC_SCHEMA.fields}
    full = [tuple({**base, **dict(zip(cols, r))}[f.name] for f in VPC_SCHEMA.fields) for r in rows]
    return spark.createDataFrame(full, VPC_SCHEMA)


T0 = datetime(2025, 10, 1, 23, 0, 0)
T1 = datetime(2025, 10, 1, 23, 10, 0)


def test_vpc_sums_nulls_and_ties(spark):
    df = _vpc(spark, [("a", "b", 22, 6, None, None, T0, T1), ("a", "b", 22, 6, None, None, T0, T1),
                      ("c", "d", 3389, 6, 1, 100, T0, T1), ("e", "f", 80, 17, 1, 100, T0, T0),
                      (None, "g", 22, 6, 1, 5, T0, T1)])
    conn = {(r.source_ip, r.destination_ip): r for r in vpc.vpc_top_connections(df).collect()}
    assert (conn[("a", "b")].total_bytes, conn[("a", "b")].flow_count) == (0, 2)   # all-NULL sum -> 0
    assert ("None", "g") not in conn and len(conn) == 3                              # NULL key not grouped
    top = vpc.vpc_top_connections(df, 1).collect()
    assert [(r.source_ip, r.total_bytes) for r in top] == [("c", 100)]               # tie broken by key
    ips = vpc.vpc_top_ips(df, 3).collect()
    assert [(r.ip, r.type) for r in ips] == [("c", "Source IP"), ("d", "Destination IP"), ("e", "Source IP")]
    ports = {r.port: r.protocol for r in vpc.vpc_top_ports(df).collect()}
    assert ports == {22: "TCP", 3389: "TCP", 80: "UDP"}
    night = vpc.vpc_night_remote(df).collect()
    assert {(r.source_ip, r.service) for r in night} == {("a", "SSH/SCP/SFTP"), ("c", "RDP")}
    sess = vpc.vpc_session_duration(df).collect()
    assert {(r.source_ip, r.duration_seconds) for r in sess} == {("a", 600), ("c", 600)}  # zero duration dropped
    assert sorted(vpc.vpc_top_connections_joined(df).collect()) == sorted(vpc.vpc_top_connections(df).collect())


def test_empty_inputs_keep_schema(spark):
    empty_vpc = spark.createDataFrame([], VPC_SCHEMA)
    for fn in (vpc.vpc_top_ips, vpc.vpc_top_ports, vpc.vpc_night_remote, vpc.vpc_session_duration,
               vpc.vpc_top_connections):
        out = fn(empty_vpc)
        assert out.count() == 0 and len(out.columns) >= 3
    empty_ct = ct.ensure_identity(spark.createDataFrame([], CLOUDTRAIL_SCHEMA))
    for fn in (ct.ct_top_ips, ct.ct_night_ips, ct.ct_night_events, ct.ct_event_names, ct.ct_user_agents,
               ct.ct_failed_auth, ct.ct_regions, ct.ct_console_login, ct.ct_create_user, ct.ct_tactics,
               ct.ct_tactic_events):
        assert fn(empty_ct).count() == 0
    empty_s3 = spark.createDataFrame([], S3_SCHEMA)
    for fn in (s3a.s3_requesters, s3a.s3_operations, s3a.s3_user_agents, s3a.s3_tactics, s3a.s3_tactic_events):
        assert fn(empty_s3).count() == 0


def _ct(spark, rows):
    cols = ["event_time", "event_time_local", "aws_region", "event_name", "source_ip_address", "user_agent",
            "error_code", "error_message", "request_elements", "user_identity"]
    base = {f.name: None for f in CLOUDTRAIL_SCHEMA.fields}
    full = [tuple({**base, **dict(zip(cols, r))}[f.name] for f in CLOUDTRAIL_SCHEMA.fields) for r in rows]
    return ct.ensure_identity(spark.createDataFrame(full, CLOUDTRAIL_SCHEMA))


def test_failed_auth_categories(spark):
    t = datetime(2025, 10, 1, 3, 0, 0)
    df = _ct(spark, [
        (t, t, "r", "GetObject", "1.1.1.1", None, "AccessDenied", "SignatureDoesNotMatch", None, {"userName": "u1"}),
        (t, t, "r", "GetObject", "1.1.1.1", None, "AccessDenied", None, None, {"userName": "u2"}),
        (t, t, "r", "GetObject", "2.2.2.2", None, None, "request has expiredtoken", None, {"type": "Root", "principalId": "root-1"}),
        (t, t, "r", "GetObject", None, None, "Throttling", None, None, {"userName": "u3"}),
    ])
    assert {tuple(r) for r in ct.ct_failed_auth(df).collect()} == {
        ("Authentication Failures - IPs", "2.2.2.2", 1, 1), ("Authentication Failures - Users", None, 0, 0),
        ("Authorization Failures - IPs", "1.1.1.1", 2, 1), ("Authorization Failures - Users", "u1", 1, 2),
        ("Authorization Failures - Users", "u2", 1, 2),
        ("API Key/Signature Errors - IPs", "1.1.1.1", 1, 1), ("API Key/Signature Errors - Users", "u1", 1, 1),
    }
    either = ct.ct_failed_auth(df, user_field=["user_name", "principal_id", "user_type"])
    assert ("Authentication Failures - Users", "root-1", 1, 1) in {tuple(r) for r in either.collect()}
    preview = {r.category: (r.distinct_values, r.preview) for r in ct.failed_auth_preview(df, 1).collect()}
    assert preview["Authorization Failures - Users"] == (2, "u1 (1)") and preview["Authentication Failures - Users"] == (0, "N/A")
    events = ct.failed_auth_events(df)
    assert events.columns[:8] == ["category", "failure_time", "failure_ip", "failure_user", "failure_account",
                                  "failure_type", "failure_message", "event_name"]
    assert events.count() == 4   # first event is in two categories


def test_failed_auth_lists_every_value_of_a_large_category(spark):
    n = 30_000
    df = ct.ensure_identity(spark.range(n).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("source_ip_address", "error_code") else
          (F.lit("AccessDenied") if f.name == "error_code" else F.concat(F.lit("ip"), F.col("id") % 20_000)).alias(f.name)
          for f in CLOUDTRAIL_SCHEMA.fields]))
    out = ct.ct_failed_auth(df)
    ips = out.where("category = 'Authorization Failures - IPs'").agg(F.count("*"), F.sum("count"), F.max("distinct_values")).first()
    assert tuple(ips) == (20_000, n, 20_000)
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan and "CollectList" not in plan


def test_console_login_and_create_user(spark):
    t = datetime(2025, 10, 1, 3, 0, 0)
    old = datetime(2025, 8, 1, 3, 0, 0)
    df = _ct(spark, [
        (t, t, "r", "ConsoleLogin", "1.1.1.1", "ua", None, None, None, {"userName": "alice"}),
        (old, old, "r", "ConsoleLogin", "1.1.1.1", "ua", "Failed authentication", None, None, {"userName": "bob"}),
        (t, t, "r", "ConsoleLogin", "1.1.1.1", "ua", None, None, None, {"userName": "Unknown"}),
        (t, t, "r", "ConsoleLogin", "1.1.1.1", "ua", None, None, None, {"type": "Root"}),
        (t, t, "r", "CreateUser", "1.1.1.1", "ua", None, None, '{"userName":"carol"}', {"arn": "arn:x"}),
        (t, t, "r", "CreateUser", "1.1.1.1", "ua", None, None, "{bad json", {"arn": "arn:x"}),
    ])
    logins = ct.ct_console_login(df).collect()
    assert [(r.user, r.login_status) for r in logins] == [("alice", "Success"), ("bob", "Failed")]
    recent = ct.ct_console_login(df, days=30, as_of="2025-10-10").collect()
    assert [r.user for r in recent] == ["alice"]
    created = sorted((r.created_user, r.created_by_arn) for r in ct.ct_create_user(df).collect())
    assert created == [("Unknown", "arn:x"), ("carol", "arn:x")]


def test_percent_denominators(spark):
    t_night = datetime(2025, 10, 1, 6, 30, 0)   # 06:xx counts for event names, not for IPs
    df = _ct(spark, [(t_night, t_night, None, "A", "1.1.1.1", None, None, None, None, None),
                     (t_night, t_night, None, None, "1.1.1.1", None, None, None, None, None),
                     (t_night, t_night, None, "A", None, None, None, None, None, None),
                     (t_night, None, None, "B", "2.2.2.2", None, None, None, None, None)])
    ev = {r.event_name: (r.nightshift_event_count, r.event_pct) for r in ct.ct_night_events(df).collect()}
    assert ev == {"A": (2, 66.67)}          # NULL name counted in the denominator, NULL local time excluded
    assert ct.ct_night_ips(df).count() == 0
    names = {r.event_name: r.event_pct for r in ct.ct_event_names(df).collect()}
    assert names == {"A": 50.0, "B": 25.0}
    regions = ct.ct_regions(df).collect()
    assert regions == []


def test_s3_requester_filter_after_limit(spark):
    base = {f.name: None for f in S3_SCHEMA.fields}

    def row(requester, ip, op="REST.GET.OBJECT", key="/k"):
        return tuple({**base, "requester": requester, "remote_ip": ip, "operation": op, "key": key,
                      "bucket": "b"}[f.name] for f in S3_SCHEMA.fields)

    df = spark.createDataFrame([row("198.51.100.1", None)] * 3 + [row("arn:aws:iam::1:user/u", "10.0.0.1")] * 2
                               + [row("-", "-")], S3_SCHEMA)
    top1 = s3a.s3_requesters(df, 1).collect()
    assert top1 == []                                   # the top row is an IP requester: removed after the cut
    first = s3a.s3_requesters(df, 1, filter_first=True).collect()
    assert [(r.requester_arn, r.source_ip, r.request_count) for r in first] == [("iam:user/u", "10.0.0.1", 2)]
    ops = s3a.s3_operations(df).collect()
    assert ops[0].prefix == "k" and ops[0]["count"] == 6


def test_documented_options(spark):
    base = {f.name: None for f in S3_SCHEMA.fields}
    rows = [tuple({**base, "operation": "REST.GET.OBJECT", "bucket": "b", "key": k}[f.name] for f in S3_SCHEMA.fields)
            for k in ["/logs/2025/a", "/logs/2025/b", "logs/2024/c", "/img/x"]]
    ops = {r.prefix: r["count"] for r in s3a.s3_operations(spark.createDataFrame(rows, S3_SCHEMA), prefix_depth=1).collect()}
    assert ops == {"logs": 3, "img": 1}
    t = datetime(2025, 10, 1, 3, 0, 0)
    df = _ct(spark, [
        (t, t, "r", "ConsoleLogin", "1.1.1.1", "ua", None, None, None, {"userName": "alice"}),
    ]).withColumn("response_elements", F.lit('{"ConsoleLogin":"Failure"}'))
    assert ct.ct_console_login(df).first().login_status == "Success"
    assert ct.ct_console_login(df, status_from="response").first().login_status == "Failed"
    fails = _ct(spark, [(t, t, "r", "X", "1.1.1.1", None, "AccessDenied", None, None, {"principalId": "AID1"})])
    users = {r.category: (r.value, r["count"]) for r in ct.ct_failed_auth(fails, user_field="principal_id").collect()}
    assert users["Authorization Failures - Users"] == ("AID1", 1)
