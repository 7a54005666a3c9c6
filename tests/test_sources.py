"""File round trips for the three log sources (plain, gzip, shapes, bad input)."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from logsift.sources import cloudtrail, manifest
from logsift.sources.cloudtrail import identity_wide, read_cloudtrail
from logsift.sources.files import Rejects
from logsift.sources.s3 import read_s3_access
from logsift.sources.vpc import read_vpc_flow


def _write(path, text, gz=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if gz:
        with gzip.open(path, "wt", encoding="utf-8") as fh:
            fh.write(text)
    else:
        with open(path, "w", encoding="utf-8") as fh:
            fh.write(text)


def _event(i, **kw):
    ev = {"eventTime": f"2025-10-01T0{i % 10}:15:00Z", "awsRegion": "ap-northeast-2", "eventName": "ConsoleLogin",
          "sourceIPAddress": f"10.0.0.{i}", "userAgent": "Mozilla/5.0 Chrome/120",
          "userIdentity": {"type": "IAMUser", "userName": f"u{i}", "arn": f"arn:aws:iam::1:user/u{i}",
                           "sessionContext": {"attributes": {"mfaAuthenticated": "false"}}},
          "requestParameters": {"userName": f"new{i}"}, "responseElements": {}, "readOnly": False,
          "eventID": f"id-{i}"}
    ev.update(kw)
    return ev


def test_cloudtrail_document_shapes(spark, tmp_dir):
    d = os.path.join(tmp_dir, "ct")
    _write(f"{d}/a/wrapped.json", json.dumps({"Records": [_event(1), _event(2)]}))
    _write(f"{d}/a/pretty.json", json.dumps({"Records": [_event(3)]}, indent=2))
    _write(f"{d}/b/array.JSON", json.dumps([_event(4), _event(5)]))
    _write(f"{d}/b/single.json.gz", json.dumps(_event(6)), gz=True)
    _write(f"{d}/c/lines.jsonl", "\n".join([json.dumps(_event(7)), "{broken", "", json.dumps(_event(8))]))
    # JSON Lines in a .json file: detected although the first line parses alone
    _write(f"{d}/c/lines_in_json.json", json.dumps(_event(9)) + "\n" + json.dumps(_event(10)) + "\n")
    # bad first line, then records
    _write(f"{d}/c/badfirst.json", "nope\n" + json.dumps(_event(11)))
    # non-object records are dropped, the rest kept
    _write(f"{d}/c/mixed.json", json.dumps({"Records": [_event(12), 5, "x", [1]]}))
    _write(f"{d}/c/ignored.txt", json.dumps(_event(99)))
    _write(f"{d}/c/empty.json", "")
    df = read_cloudtrail(spark, d)
    ids = sorted(r.event_id for r in df.select("event_id").collect())
    assert ids == sorted(f"id-{i}" for i in range(1, 13))
    row = df.filter(F.col("event_id") == "id-1").first()
    assert row.source_ip_address == "10.0.0.1"
    assert row.user_name == "u1" and row.user_type == "IAMUser"
    assert row.request_elements == '{"userName":"new1"}'
    assert row.response_elements is None          # empty object -> NULL
    assert row.read_only is False
    assert row.source_file == "wrapped.json"
    assert str(row.event_time) == "2025-10-01 01:15:00"
    assert str(row.event_time_local) == "2025-10-01 10:15:00"   # +9 h
    assert json.loads(row.user_identity["sessionContext"]) == {"attributes": {"mfaAuthenticated": "false"}}


def test_large_json_lines_under_other_names_are_read_by_line(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(cloudtrail, "LARGE_BYTES", 3000, raising=False)
    monkeypatch.setattr(cloudtrail, "LARGE_GZIP", 300, raising=False)
    d = os.path.join(tmp_dir, "large files")
    text = "\n \n" + "\r\n".join([json.dumps(_event(i, requestParameters={"text": "a\rb"})) for i in range(20)] + ["{broken", "7", json.dumps({"Records": [_event(20), 5]})])
    _write(f"{d}/a b%20c.json", text)
    _write(f"{d}/days/lines.json.gz", text, gz=True)
    _write(f"{d}/days/few.json", json.dumps(_event(1)) + "\n" + json.dumps(_event(2)))
    _write(f"{d}/one_line.json", json.dumps({"Records": [_event(i) for i in range(20)]}))
    _write(f"{d}/pretty.json", json.dumps({"Records": [_event(i) for i in range(20)]}, indent=1))
    _write(f"{d}/badfirst.json", "nope\n" + text)
    _write(f"{d}/rows.jsonl", text)
    docs, _ = cloudtrail.raw_cloudtrail(spark, d)
    assert sorted(r.source_file for r in docs.collect()) == ["badfirst.json", "few.json", "one_line.json", "pretty.json"]
    seen, whole_seen = Rejects(), Rejects()
    by_line, whole = read_cloudtrail(spark, d, rejects=seen), read_cloudtrail(spark, d, jsonl_by_line=False, rejects=whole_seen)
    assert sorted(map(str, by_line.collect())) == sorted(map(str, whole.collect())) and by_line.count() == 4 * 21 + 2 + 2 * 20
    assert seen.total() == whole_seen.total() == 4 * 3 + 1
    table = os.path.join(tmp_dir, "manifest")
    manifest.update_manifest(spark, d, table, "cloudtrail")
    got = manifest.read_manifest(spark, manifest.manifest_files(spark, table), "cloudtrail")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_a_document_is_parsed_once(spark):
    """No filter below the projections that parse: it would hold the parsing again, several times over."""
    text = " \t\n" + json.dumps(_event(1), indent=1)
    docs = spark.createDataFrame([(text, "a.json"), (json.dumps([_event(2)]) + "\n", "b.json"), ("\x0b{\n", "c.json"), (" \n", "d.json"), (None, "e.json")],
                                 "value string, source_file string").repartition(1)
    found = cloudtrail.document_records(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "from_json" in line]
    assert plan.count("ArrayType(StringType,true),true)") <= 2                   # the root of a document, and of a line
    assert sorted(r.source_file for r in found.collect()) == ["a.json", "b.json"]
    assert {r.source_file: r.rejected for r in cloudtrail.cloudtrail_rejects(docs).collect()} == {"c.json": 1}


def test_the_csv_round_trip_parses_once(spark, monkeypatch):
    import __spark_entry__ as entry

    parsed, plans = [], []
    keys, parse = entry.identity_keys, entry.parse_cloudtrail_docs
    monkeypatch.setattr(entry, "parse_cloudtrail_docs", lambda *a: parsed.append(parse(*a)) or parsed[-1])
    monkeypatch.setattr(entry, "identity_keys", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keys(df))
    sf = "/root/testdata/sf0.001"
    out = entry.queries()["load_cloudtrail_csv"](spark, sf)
    assert len(parsed) == len(plans) == 1 and "from_json" not in plans[0]
    assert out.count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_cloudtrail_jsonl_whole_document_mode(spark, tmp_dir):
    d = os.path.join(tmp_dir, "ct2")
    _write(f"{d}/x.jsonl", json.dumps(_event(1)) + "\n" + json.dumps({"Records": [_event(2), _event(3)]}))
    by_line = read_cloudtrail(spark, d)
    whole = read_cloudtrail(spark, d, jsonl_by_line=False)
    assert sorted(r.event_id for r in by_line.collect()) == ["id-1", "id-2", "id-3"]
    assert sorted(r.event_id for r in whole.collect()) == ["id-1", "id-2", "id-3"]


def test_cloudtrail_missing_fields_and_local_time(spark, tmp_dir):
    d = os.path.join(tmp_dir, "ct3")
    recs = [{"eventTime": "2025-10-01T20:00:00Z", "awsRegion": "ap-south-1", "eventName": "X"},
            {"eventTime": "not a time", "awsRegion": "us-east-1", "eventName": "Y"},
            {"eventTime": "2025-10-01T20:00:00Z", "awsRegion": "mars-1", "eventName": "Z"},
            {"eventTime": "2025-10-01T20:00:00Z", "eventName": "W", "userIdentity": {}}]
    _write(f"{d}/r.json", json.dumps({"Records": recs}))
    rows = {r.event_name: r for r in read_cloudtrail(spark, d).collect()}
    assert str(rows["X"].event_time_local) == "2025-10-02 01:30:00"     # +5:30
    assert rows["Y"].event_time is None and rows["Y"].event_time_local is None
    assert str(rows["Z"].event_time_local) == "2025-10-01 20:00:00"     # unknown region: +0
    assert rows["W"].event_time_local is None                         # no region
    assert rows["W"].user_identity is None and rows["W"].user_name is None


def test_identity_wide(spark, tmp_dir):
    d = os.path.join(tmp_dir, "ct4")
    _write(f"{d}/r.json", json.dumps({"Records": [_event(1), _event(2, userIdentity={"type": "Root", "principalId": "p"})]}))
    w = identity_wide(read_cloudtrail(spark, d))
    cols = [c for c in w.columns if c.startswith("userIdentity.")]
    assert "userIdentity.principalId" in cols and "userIdentity.userName" in cols and "user_identity" in w.columns
    few = identity_wide(read_cloudtrail(spark, d), ["principalId", "custom"])
    assert {(r["userIdentity.principalId"], r["userIdentity.custom"]) for r in few.collect()} == {(None, None), ("p", None)}


VPC_LINES = """version account-id interface-id srcaddr dstaddr srcport dstport protocol packets bytes start end action log-status
# comment
2 123456789012 eni-1 10.0.0.1 10.0.0.2 49152 22 6 5 500 1759273200 1759273260 ACCEPT OK
2 123456789012 eni-1 - - - - - - - 1759273200 1759273260 - NODATA

2 123456789012 eni-1 10.0.0.1
2\t123456789012  eni-1 10.0.0.3 10.0.0.4 1 3389 6 1 10 1759273200 1759273201 REJECT
"""


def test_vpc_lines(spark, tmp_dir):
    d = os.path.join(tmp_dir, "vpc")
    _write(f"{d}/x/a.log", VPC_LINES)
    _write(f"{d}/x/b.TXT.gz", VPC_LINES, gz=True)
    _write(f"{d}/2025-10-01-00-00-00-ABCDEF01", VPC_LINES)
    _write(f"{d}/ignored.csv", VPC_LINES)
    df = read_vpc_flow(spark, d)
    assert df.count() == 9
    ok = df.filter(F.col("srcaddr") == "10.0.0.1").first()
    assert (ok.srcport, ok.dstport, ok.protocol, ok.packets, ok.bytes) == (49152, 22, 6, 5, 500)
    assert str(ok.window_start) == "2025-09-30 23:00:00" and ok.flow_log_status == "OK"
    nodata = df.filter(F.col("flow_log_status") == "NODATA").first()
    assert nodata.srcaddr == "-" and nodata.bytes is None and nodata.action == "-"
    short = df.filter(F.col("dstaddr") == "10.0.0.4").first()
    assert short.flow_log_status is None and short.action == "REJECT"


def test_missing_directory_is_an_error_and_an_empty_one_is_not(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "none"))
    for read in (read_vpc_flow, read_s3_access, read_cloudtrail):
        with pytest.raises(FileNotFoundError):
            read(spark, os.path.join(tmp_dir, "nope"))
        with pytest.raises(FileNotFoundError):
            read(spark, [os.path.join(tmp_dir, "nope"), os.path.join(tmp_dir, "nor this")])
        assert read(spark, os.path.join(tmp_dir, "none")).count() == 0


S3_LINES = (
    'OWNER bkt [01/Oct/2025:11:55:11 +0000] 203.0.113.1 arn:aws:iam::123456789012:user/u1 REQ1 REST.GET.OBJECT a/b '
    '"GET /a/b HTTP/1.1" 200 - 10 20 5 4 "-" "aws-cli/2.1 Python/3" - HOSTID SigV4 CIPHER AuthHeader host TLSv1.2 - -\n'
    'OWNER bkt [01/Oct/2025:11:55:11 +0900] - svc REQ2 S3.EXPIRE.OBJECT a/b - - - - 20 - - - - - HOSTID\n'
    '# comment\n\n'
)


def test_s3_lines(spark, tmp_dir):
    d = os.path.join(tmp_dir, "s3")
    _write(f"{d}/log.log", S3_LINES)
    rows = {r.request_id: r for r in read_s3_access(spark, d).collect()}
    assert set(rows) == {"REQ1", "REQ2"}
    full, fb = rows["REQ1"], rows["REQ2"]
    assert full.parse_status == "full" and fb.parse_status == "fallback"
    assert full.request_uri == "GET /a/b HTTP/1.1" and full.user_agent == "aws-cli/2.1 Python/3"
    assert full.http_status_code == 200 and full.bytes_sent == 10 and full.referer == "-"
    assert full.tls_version == "TLSv1.2" and full.dash2 == "-"
    assert str(full.request_datetime) == "2025-10-01 11:55:11"
    # bracket-aware fallback: fields do not shift, offset applied
    assert fb.remote_ip == "-" and fb.requester == "svc" and fb.operation == "S3.EXPIRE.OBJECT"
    assert str(fb.request_datetime) == "2025-10-01 02:55:11"
    # every token is kept, also beyond the 18th
    assert fb.host_id == "HOSTID" and fb.version_id == "-" and fb.object_size == 20 and fb.tls_version is None


def test_s3_appended_fields_and_quotes(spark):
    from logsift.sources.s3 import parse_s3_lines

    base = S3_LINES.split("\n")[0]
    odd = base.replace('"GET /a/b HTTP/1.1"', '"GET /a"b"c HTTP/1.1"').replace('"aws-cli/2.1 Python/3"', '-')
    lines = [base + ' AccessPoint "more text"', odd, base.replace("+0000", "-0330"), base.rsplit(" ", 2)[0]]
    rows = parse_s3_lines(spark.createDataFrame([(v, str(i)) for i, v in enumerate(lines)], "value string, source_file string"))
    a, b, c, d = rows.orderBy("source_file").collect()
    assert (a.parse_status, a.extra_fields, a.host_id, a.tls_version, a.dash2) == ("full", 'AccessPoint "more text"', "HOSTID", "TLSv1.2", "-")
    assert (b.parse_status, b.request_uri, b.user_agent, b.extra_fields) == ("full", 'GET /a"b"c HTTP/1.1', "-", None)
    assert str(c.request_datetime) == "2025-10-01 15:25:11"
    assert (d.parse_status, d.tls_version, d.dash1, d.user_agent) == ("fallback", "TLSv1.2", None, "aws-cli/2.1 Python/3")


def test_cloudtrail_records_survive_their_neighbours(spark, tmp_dir):
    """A repeated key, values that are no objects, and a document beyond the size of one VARIANT."""
    from logsift.sources.cloudtrail import cloudtrail_rejects, parse_cloudtrail_docs

    good = json.dumps(_event(1)), json.dumps(_event(2))
    docs = [(f'{{"Records":[{good[0]},{{"eventID":"x","eventID":"dup","requestParameters":{{"userName":"a","userName":"b"}},'
             f'"userIdentity":{{"userName":"x","userName":"y"}}}},{good[1]}]}}', "dup"),
            (f'{{"Records":[{good[0]},7,"text",null,{good[1]}]}}', "values"),
            (good[0] + "\n{broken\n" + '{"eventID":"q","k":1,"k":2}', "lines"), ('{"Records":[' + good[0], "cut")]
    frame = spark.createDataFrame(docs, "value string, source_file string")
    got = {(r.source_file, r.event_id): r for r in parse_cloudtrail_docs(frame).collect()}
    assert set(got) == {("dup", "id-1"), ("dup", "dup"), ("dup", "id-2"), ("values", "id-1"), ("values", "id-2"), ("lines", "id-1"), ("lines", "q")}
    assert got["dup", "dup"].user_name == "y" and got["dup", "dup"].request_elements == '{"userName":"a","userName":"b"}'
    from logsift.operators.cloudtrail import ct_create_user
    created = ct_create_user(parse_cloudtrail_docs(frame).withColumn("event_name", F.lit("CreateUser")).where("event_id = 'dup'"))
    assert created.first().created_user == "b"
    assert {(r.source_file, r.reason, r.rejected) for r in cloudtrail_rejects(frame).collect()} == {
        ("values", "not an object", 3), ("lines", "not JSON", 1), ("cut", "not JSON", 1)}
    big = spark.range(1).selectExpr(
        "concat('{\"Records\":[', array_join(transform(sequence(1, 150000), i -> concat('{\"eventID\":\"e', i, '\",\"userAgent\":\"', "
        "repeat('x', 950), '\"}')), ','), ']}') AS value", "'big' AS source_file")
    assert parse_cloudtrail_docs(big, columns=["event_id"]).select(F.countDistinct("event_id")).first()[0] == 150_000


def test_cloudtrail_columns_and_lines_by_name(spark, tmp_dir):
    d = os.path.join(tmp_dir, "ct_cols")
    _write(f"{d}/export-1.json", "\n".join(json.dumps(_event(i)) for i in range(5)))
    _write(f"{d}/a.json", json.dumps({"Records": [_event(7)]}))
    df = read_cloudtrail(spark, d, lines_regex="^export-", columns=["event_time", "event_name", "user_name"])
    assert df.count() == 6 and "user_agent" not in df.columns
    assert {(str(r.event_time), r.user_name) for r in df.collect()} == {(f"2025-10-01 0{i}:15:00", f"u{i}") for i in (0, 1, 2, 3, 4, 7)}


def test_rejects_are_counted_while_parsing(spark, tmp_dir):
    from logsift.sources.files import Rejects

    _write(f"{tmp_dir}/rj/vpc/a.log", VPC_LINES)
    _write(f"{tmp_dir}/rj/s3/a.log", S3_LINES)
    _write(f"{tmp_dir}/rj/ct/a.json", json.dumps({"Records": [_event(1), 5]}))
    _write(f"{tmp_dir}/rj/ct/b.jsonl", json.dumps(_event(1)) + "\n{broken\n")
    for read, name, want in ((read_vpc_flow, "vpc", 1), (read_s3_access, "s3", 1), (read_cloudtrail, "ct", 2)):
        rejects = Rejects()
        read(spark, f"{tmp_dir}/rj/{name}", rejects=rejects).write.parquet(f"{tmp_dir}/rj/out/{name}")
        assert rejects.total() == want


def test_odd_numbers_do_not_end_a_job(spark):
    from logsift.operators import vpc
    from logsift.sources.vpc import parse_vpc_lines

    epochs = ["1704067200000000", "9" * 17, "9" * 25, "-1", "0", "253402300799", "253402300800"]
    lines = [f"2 1 eni a b 1 22 6 1 9223372036854775000 {e} {e} ACCEPT OK" for e in epochs]
    df = parse_vpc_lines(spark.createDataFrame([(v, "f") for v in lines] + [(None, "f")], "value string, source_file string"))
    assert sorted(str(r.window_start) for r in df.collect()) == sorted(["None"] * 5 + ["1970-01-01 00:00:00", "9999-12-31 23:59:59"])
    more = df.unionByName(df.limit(1).withColumn("srcaddr", F.lit("z")).withColumn("bytes", F.lit(5).cast("long")))
    top = vpc.vpc_top_connections(more, 5).collect()
    # a sum beyond bigint is NULL and comes first
    assert [(r.source_ip, r.total_bytes, r.flow_count) for r in top] == [("a", None, 7), ("z", 5, 1)]


def test_cloudtrail_wrapper_edge_cases(spark):
    from logsift.sources.cloudtrail import parse_cloudtrail_docs

    docs = [('{"Records": "x"}', "a"), ('{"Records": null}', "b"), ('{"Records": []}', "c"), ("{}", "d"),
            ("[]", "e"), ('"str"', "f"), ('{"Records": [{"eventName": "A"}, null, 3]}', "g"), ("   ", "h"),
            ('{"eventName": "B", "Records": 5}', "i")]
    df = parse_cloudtrail_docs(spark.createDataFrame(docs, "value string, source_file string"))
    # a Records key that is not a list yields nothing; {} is one (empty) event; non-objects are dropped
    assert sorted((r.source_file, r.event_name) for r in df.collect()) == [("d", None), ("g", "A")]


def test_missing_path_in_list_is_skipped(spark, tmp_dir):
    d = os.path.join(tmp_dir, "vpc_list")
    _write(f"{d}/day1/a.log", VPC_LINES)
    df = read_vpc_flow(spark, [f"{d}/day1", f"{d}/day2-not-delivered"])
    assert df.count() == 3


def test_corrupt_gzip_fails_unless_it_may_be_skipped(spark, tmp_dir):
    d = os.path.join(tmp_dir, "vpc_corrupt")
    _write(f"{d}/good.log", VPC_LINES)
    blob = gzip.compress(VPC_LINES.encode() * 50)
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/truncated.log.gz", "wb") as fh:
        fh.write(blob[: len(blob) // 2])
    with open(f"{d}/not_gzip.gz", "wb") as fh:
        fh.write(b"plain text, wrong extension")
    with pytest.raises(Exception):
        read_vpc_flow(spark, d).count()
    df = read_vpc_flow(spark, d, ignore_corrupt=True)
    assert df.filter(F.col("source_file") == "good.log").count() == 3
