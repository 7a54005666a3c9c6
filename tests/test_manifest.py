"""Manifest of files: days, increments, dealing of gzip files."""

import gzip
import json
import os
import random
import shutil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift.sources import manifest as m
from logsift.sources.cloudtrail import read_cloudtrail
from logsift.sources.vpc import read_vpc_flow

LINE = "2 123456789012 eni-1 10.0.0.{} 10.1.0.1 1 22 6 5 {} 1704067200 1704067260 ACCEPT OK"


def put(root, day, name, data, account="123456789012", region="us-east-1", service="CloudTrail"):
    folder = os.path.join(root, "AWSLogs", account, service, region, *day.split("-"))
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with (gzip.open if name.endswith(".gz") else open)(path, "wb") as f:
        f.write(data)
    return path


def trail(n, first=0):
    return json.dumps({"Records": [{"eventID": f"e{first + i}", "eventTime": "2024-01-01T00:00:00Z", "eventName": "X"} for i in range(n)]}).encode()


@pytest.fixture()
def archive(tmp_dir):
    root = os.path.join(tmp_dir, "logs")
    put(root, "2024-01-01", "a.json.gz", trail(3))
    put(root, "2024-01-02", "b.json.gz", trail(4, 100))
    put(root, "2024-01-02", "c.json", trail(5, 200), region="eu-west-1")
    put(root, "2024-01-03", "d.jsonl", b'{"eventID":"l1"}\n{"eventID":"l2"}\n', account="999999999999")
    put(root, "2024-01-03", "digest.txt", b"no log")
    return root


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_a_selection_reads_its_files_only(spark, archive, tmp_dir):
    table = os.path.join(tmp_dir, "manifest")
    m.update_manifest(spark, archive, table, "cloudtrail")
    every = m.manifest_files(spark, table)
    assert ids(m.read_manifest(spark, every, "cloudtrail")) == ids(read_cloudtrail(spark, archive))
    rows = {r.name: r for r in every.collect()}
    assert set(rows) == {"a.json.gz", "b.json.gz", "c.json", "d.jsonl"}
    assert rows["c.json"].region == "eu-west-1" and rows["d.jsonl"].account == "999999999999" and str(rows["a.json.gz"].delivery_date) == "2024-01-01"
    shutil.rmtree(os.path.join(archive, "AWSLogs", "123456789012", "CloudTrail", "us-east-1", "2024", "01", "01"))     # not to be opened
    day = m.manifest_files(spark, table, "2024-01-02", "2024-01-02")
    assert "PartitionFilters: [isnotnull(delivery_date" in day._jdf.queryExecution().executedPlan().toString()
    assert len(ids(m.read_manifest(spark, day, "cloudtrail"))) == 9
    assert len(ids(m.read_manifest(spark, m.manifest_files(spark, table, "2024-01-02", regions=["eu-west-1"]), "cloudtrail"))) == 5
    assert ids(m.read_manifest(spark, m.manifest_files(spark, table, accounts=["999999999999"]), "cloudtrail")) == ["l1", "l2"]
    assert ids(m.read_manifest(spark, m.manifest_files(spark, table, "2025-01-01"), "cloudtrail")) == []


def test_days_are_listed_by_increments(spark, archive, tmp_dir):
    table, done = os.path.join(tmp_dir, "manifest"), os.path.join(tmp_dir, "done")
    m.update_manifest(spark, archive, table, "cloudtrail", ["2024-01-01", "2024-01-02"])
    first = m.new_files(m.manifest_files(spark, table), done)
    assert sorted(r.name for r in first.collect()) == ["a.json.gz", "b.json.gz", "c.json"]
    m.mark_done(first, done)
    os.remove(put(archive, "2024-01-01", "a.json.gz", b""))
    late = put(archive, "2024-01-02", "late.json.gz", trail(2, 300))
    put(archive, "2024-01-02", "b.json.gz", trail(6, 100))                    # delivered anew
    m.update_manifest(spark, archive, table, "cloudtrail", ["2024-01-01", "2024-01-02"])
    second = m.new_files(m.manifest_files(spark, table), done)
    assert sorted(r.name for r in second.collect()) == ["b.json.gz", "late.json.gz"] and os.path.exists(late)
    assert sorted(r.name for r in m.manifest_files(spark, table).collect()) == ["b.json.gz", "c.json", "late.json.gz"]
    m.update_manifest(spark, archive, table, "cloudtrail", ["2024-02-01"])     # a day without a folder
    assert m.manifest_files(spark, table, "2024-02-01").count() == 0 and m.manifest_files(spark, table).count() == 3


def test_gzip_lines_equal_the_text_source(spark, tmp_dir):
    rng = random.Random(4)
    root = os.path.join(tmp_dir, "vpc")
    for n in range(6):
        ends = [b"\n", b"\r\n", b"\r"]
        data = b"".join(LINE.format(i, rng.randrange(10**6)).encode() + rng.choice(ends) for i in range(rng.randrange(1, 400)))
        path = put(root, f"2024-01-0{1 + n % 3}", f"f{n}.log.gz", data, service="vpcflowlogs")
        with open(path, "ab") as f:
            f.write(gzip.compress(LINE.format(n, n).encode()))                # a second member, without a line end
    put(root, "2024-01-02", "plain.log", LINE.format(9, 9).encode(), service="vpcflowlogs")
    table = os.path.join(tmp_dir, "manifest")
    m.update_manifest(spark, root, table, "vpc")
    got = m.read_manifest(spark, m.manifest_files(spark, table), "vpc")
    assert sorted(map(str, got.collect())) == sorted(map(str, read_vpc_flow(spark, root).collect()))
    days = m.read_manifest(spark, m.manifest_files(spark, table, last_day="2024-01-01"), "vpc")
    assert {r.source_file for r in days.select("source_file").distinct().collect()} == {"f0.log.gz", "f3.log.gz"}


def test_a_damaged_file_fails_or_keeps_what_can_be_read(spark, tmp_dir):
    root, table = os.path.join(tmp_dir, "vpc"), os.path.join(tmp_dir, "manifest")
    lines = b"".join(LINE.format(i % 250, i * 7919 % 10**6).encode() + b"\n" for i in range(50_000))
    path = put(root, "2024-01-01", "f.log.gz", lines, service="vpcflowlogs")
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) // 2)
    m.update_manifest(spark, root, table, "vpc")
    files = m.manifest_files(spark, table)
    with pytest.raises(Exception, match="gzip file ends|EOFError"):
        m.read_manifest(spark, files, "vpc").count()
    assert 1_000 < m.read_manifest(spark, files, "vpc", ignore_corrupt=True).count() < 50_000


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=40), st.integers(1, 8))
@settings(max_examples=100, deadline=None)
def test_files_are_dealt_evenly(sizes, tasks):
    dealt = m.deal([(str(i), n) for i, n in enumerate(sizes)], tasks)
    load = [sum(n for i, n in enumerate(sizes) if dealt[str(i)] == t) for t in range(tasks)]
    assert len(dealt) == len(sizes) and max(load) <= max(max(sizes), 4 / 3 * max(sum(sizes) / tasks, max(sizes)))


@given(st.binary(max_size=60).map(lambda b: b.translate(bytes(b"\n\r ab"[i % 5] for i in range(256)))), st.lists(st.integers(1, 9), max_size=20))
@settings(max_examples=200, deadline=None)
def test_lines_across_pieces(data, cuts):
    pieces, at = [], 0
    for c in cuts:
        pieces.append(data[at:at + c])
        at += c
    pieces.append(data[at:])
    assert list(m.lines_of(pieces)) == [x.decode().encode() for x in data.splitlines()]


def test_dates_of_names(spark):
    rows = [("/b/AWSLogs/1/CloudTrail/r/2024/02/30/x.json", "x.json"), ("/b/2024-05-06-07-08-09-AB", "2024-05-06-07-08-09-AB"), ("/b/x", "x")]
    got = spark.createDataFrame(rows, "path string, name string").select(m.delivery_date(F.col("path"), F.col("name")).alias("d")).collect()
    assert [None if r.d is None else str(r.d) for r in got] == [None, "2024-05-06", None]
