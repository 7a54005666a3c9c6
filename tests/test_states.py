"""Mergeable states: the same tables as the analyses over events, by one pass or by days."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from logsift import fixtures as fx
from logsift.operators import cloudtrail as ct
from logsift.operators import s3 as s3a
from logsift.operators import vpc
from logsift.operators.enrich import tactic_lookup
from logsift.plans import bundle, states

SF = "/root/testdata/sf0.001"
FRAMES = {"cloudtrail": fx.ct_frame, "vpc": fx.vpc_frame, "s3": fx.s3_frame}
PLAIN = {
    "cloudtrail": [ct.ct_top_ips, ct.ct_night_ips, ct.ct_night_events, ct.ct_event_names, ct.ct_user_agents, ct.ct_failed_auth,
                   ct.ct_regions, ct.ct_console_login, ct.ct_create_user, ct.ct_tactics, lambda d: ct.ct_tactic_events(d, sort=False)],
    "vpc": [vpc.vpc_top_ips, vpc.vpc_top_ports, vpc.vpc_night_remote, vpc.vpc_session_duration, vpc.vpc_top_connections],
    "s3": [s3a.s3_requesters, s3a.s3_operations, s3a.s3_user_agents, s3a.s3_tactics, s3a.s3_tactic_events],
}
NAMES = {"cloudtrail": bundle.CLOUDTRAIL_TABLES, "vpc": bundle.VPC_TABLES, "s3": bundle.S3_TABLES}


def same(a, b, name=""):
    assert a.dtypes == b.dtypes, name
    key = lambda r: str(r.asDict())
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key), name


@pytest.mark.parametrize("log_type", FRAMES)
def test_a_bundle_has_the_tables_of_the_analyses(spark, log_type):
    df = FRAMES[log_type](spark, SF)
    tables = bundle.run_analysis(df, log_type)
    for name, plain in zip(NAMES[log_type], PLAIN[log_type]):
        same(tables[name], plain(df), name)
    if log_type == "cloudtrail":
        same(tables["Failed_Auth_Events"], ct.failed_auth_events(df))


def test_a_bundle_scans_the_landed_table_twice_at_most(spark, tmp_dir):
    """CloudTrail and VPC tables don't read the landed files any more; of S3, only the tagged requests do."""
    for log_type, frame in FRAMES.items():
        path = os.path.join(tmp_dir, log_type)
        bundle.write_parsed(frame(spark, SF), path, log_type)
        tables = bundle.run_analysis(spark.read.parquet(path), log_type)
        reading = [n for n, t in tables.items() if any(path in f for f in t.inputFiles())]
        assert reading == ([] if log_type != "s3" else ["Mitre_ATTACK_Events", "Report_Event_Preview"])


def test_user_tactics_and_policies(spark):
    df = fx.ct_frame(spark, SF)
    config = {"cloudtrail": {"One": ["ListUsers", "GetObject"], "Two": ["GetObject", "NoSuchEvent"]}}
    lookup = tactic_lookup(spark, "cloudtrail", config, policy="all")
    tables = bundle.run_analysis(df, "cloudtrail", lookup=lookup)
    same(tables["Mitre_ATTACK_Tactics"], ct.ct_tactics(df, lookup))
    same(tables["Mitre_ATTACK_Events"], ct.ct_tactic_events(df, lookup, sort=False))
    same(tables["ConsoleLogin_Statistics"], ct.ct_console_login(df))


def test_empty_events(spark):
    for log_type, frame in FRAMES.items():
        for name, t in bundle.run_analysis(frame(spark, SF).where("false"), log_type, as_of="2024-01-31").items():
            assert t.count() == 0, name


@pytest.mark.parametrize("log_type", FRAMES)
def test_days_one_by_one_equal_the_whole(spark, tmp_dir, log_type):
    """Three deliveries, one of them twice: first a part of its days, then all of it."""
    df = FRAMES[log_type](spark, SF)
    day = F.to_date(states.TIME_COLUMN[log_type])
    path = os.path.join(tmp_dir, "states")
    thirds = [df.where(F.dayofmonth(day) % 3 == i) for i in range(2)] + [df.where(day.isNull() | (F.dayofmonth(day) % 3 == 2))]
    for part in (thirds[0], thirds[1].where(F.rand(3) < 0.5), thirds[2], thirds[1]):
        states.update_states(part, path, log_type)
    tables = states.ranked_tables(states.read_states(spark, path), log_type)
    plain = dict(zip(NAMES[log_type], PLAIN[log_type]))
    for name, table in tables.items():
        same(table, plain[name](df), name)
    assert states.state_days(spark, path).agg(F.sum("events")).first()[0] == df.count()


def test_an_update_reads_its_days_only(spark, tmp_dir):
    landed, path = os.path.join(tmp_dir, "landed"), os.path.join(tmp_dir, "states")
    df = fx.vpc_frame(spark, SF)
    bundle.write_parsed(df, landed, "vpc")
    parsed = spark.read.parquet(landed)
    states.update_states(parsed, path, "vpc", ["2024-01-03", "2024-01-04"])
    for d in os.listdir(landed):
        if d.startswith("event_date=") and d not in ("event_date=2024-01-05", "event_date=2024-01-06"):
            shutil.rmtree(os.path.join(landed, d))          # the update below can't read these
    states.update_states(parsed, path, "vpc", ["2024-01-05", "2024-01-06"])
    table = states.ranked_tables(states.read_states(spark, path), "vpc", top_n=1000)["Connection_Statistics_(Top_20)"]
    same(table, vpc.vpc_top_connections(df.where(F.to_date("window_start").between("2024-01-03", "2024-01-06")), 1000))
    some = states.read_states(spark, path, first_day="2024-01-04", last_day="2024-01-05")
    same(states.ranked_tables(some, "vpc")["Access_IP_Statistics_(Top_20)"],
         vpc.vpc_top_ips(df.where(F.to_date("window_start").between("2024-01-04", "2024-01-05"))))


def test_a_redelivered_day_without_events_is_emptied(spark, tmp_dir):
    path = os.path.join(tmp_dir, "states")
    df = fx.ct_frame(spark, SF)
    states.update_states(df, path, "cloudtrail", ["2024-01-03", "2024-01-04"])
    states.update_states(df.where("false"), path, "cloudtrail", ["2024-01-03"])
    got = {str(r.event_date): r.events for r in states.state_days(spark, path).collect()}
    assert got["2024-01-03"] == 0 and got["2024-01-04"] == df.where(F.to_date("event_time") == "2024-01-04").count() > 0
    table = states.ranked_tables(states.read_states(spark, path), "cloudtrail")["EventName_Statistics"]
    same(table, ct.ct_event_names(df.where(F.to_date("event_time") == "2024-01-04")))
    assert states.read_states(spark, os.path.join(tmp_dir, "none")).count() == 0


def test_sums_beyond_bigint_stay_null_when_merged(spark):
    big = (1 << 63) - 10
    rows = [("a", "b", big, 1, "2024-01-01 00:00:00"), ("a", "b", big, 1, "2024-01-01 01:00:00"), ("a", "b", 1, 1, "2024-01-02 00:00:00"),
            ("c", "b", big, 1, "2024-01-01 00:00:00"), ("c", "b", 11, 1, "2024-01-02 00:00:00"), ("d", "b", None, 1, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "srcaddr string, dstaddr string, bytes long, packets long, t string").select(
        "*", F.col("t").cast("timestamp_ntz").alias("window_start"), F.col("t").cast("timestamp_ntz").alias("window_end"),
        F.lit(22).cast("long").alias("dstport"), F.lit(6).cast("long").alias("protocol"))
    tables = states.ranked_tables(states.merged_states(states.event_states(df, "vpc")), "vpc")
    same(tables["Connection_Statistics_(Top_20)"], vpc.vpc_top_connections(df))


def test_flows_are_summed_before_the_dimensions(spark):
    """A flow makes a row or so for its pair and one for its port, not one for every dimension; the states are those of every dimension by itself."""
    from datetime import datetime

    rng, top = random.Random(5), 9223372036854775000
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, "c"]), rng.choice([None, 22, 443]), rng.choice([None, 6]), rng.choice([None, 1, 5, top]),
             rng.choice([None, 2]), start, None if start is None or rng.random() < 0.2 else datetime(2024, 1, 1, 23, rng.choice([0, 30])))
            for start in [rng.choice([None, datetime(2024, 1, 1, 23, 10), datetime(2024, 1, 1, 12), datetime(2023, 12, 31, 2)]) for _ in range(300)]]
    flows = spark.createDataFrame(rows, "srcaddr string, dstaddr string, dstport bigint, protocol bigint, bytes bigint, packets bigint, "
                                        "window_start timestamp_ntz, window_end timestamp_ntz")
    found = states.event_states(flows, "vpc")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    kinds = [line.split()[0] if line.split()[0] in ("Aggregate", "Generate") else None for line in (x.lstrip(" +-:") for x in plan.splitlines()) if line.split()]
    assert [k for k in kinds if k] == ["Aggregate", "Generate", "Aggregate", "Generate"]
    want = {}
    for src, dst, port, protocol, n_bytes, packets, start, end in rows:
        day, seconds = start and start.date(), (end - start).total_seconds() if start and end else None
        night = start is not None and (start.hour >= 22 or start.hour < 6)
        keys = [("day",)] + [("ip", src, vpc.TYPE_SOURCE)] * (src is not None) + [("ip", dst, vpc.TYPE_DESTINATION)] * (dst is not None)
        keys += [("port", str(port), str(protocol))] * (port is not None and protocol is not None)
        if src and dst:
            keys += [("connection", src, dst)] + [("session", src, dst)] * (seconds is not None and seconds > 0)
            keys += [("night_remote", src, dst, str(port), str(protocol))] * (night and port == 22 and protocol is not None)
        for key in keys:
            w = want.setdefault((*key, *[None] * (5 - len(key)), day), [0, 0, 0, None])
            w[0] += 1
            if key[0] != "day":
                w[1], w[2] = w[1] + (n_bytes or 0), w[2] + (packets or 0)
            if key[0] == "session":
                w[3] = max(w[3] or 0, seconds)
    got = {(r.dim, r.k1, r.k2, r.k3, r.k4, r.event_date): [r.n, r.s1, r.s2, r.longest] for r in found.collect()}
    assert got == {k: [n, None if s1 > 2 ** 63 - 1 else s1, s2, longest] for k, (n, s1, s2, longest) in want.items()}
