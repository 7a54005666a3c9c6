"""Documents read by byte ranges against the whole-text reader."""

import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logsift import fixtures as fx
from logsift.sources import ranges
from logsift.sources.cloudtrail import read_cloudtrail

SF = "/root/testdata/sf0.001"
NASTY = ['}', '{"a":[', '\\', '\\"', '"}', '[{', ']}', '"Records":[{', 'é}漢', '\n}\n', '\\\\', '{' * 5, '"', ',', "\t"]


@pytest.fixture()
def small_ranges(spark):
    """Ranges of 900 bytes, packed into few or many tasks."""
    keys = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def record(rng, i):
    nasty = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randrange(6)))
    rec = {"eventID": f"e{i}", "eventName": nasty() or "x", "userAgent": nasty(), "requestParameters": {"k}": nasty(), "deep": [{"a": {"b": nasty()}}]},
           "resources": [{"ARN": nasty()}, {}]}
    if rng.random() < 0.1:
        rec["errorMessage"] = "long {}[]\" \\ " * rng.randrange(200)          # over several ranges
    return rec


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def rows(df):
    return sorted((str(r) for r in df.select("event_id", "event_name", "user_agent", "request_elements", "resources", "error_message", "source_file").collect()))


@pytest.mark.parametrize("indent", [None, 1])
def test_nasty_documents(spark, tmp_dir, small_ranges, indent):
    rng = random.Random(5)
    docs = {
        "plain.json": {"Records": [record(rng, i) for i in range(24)]},
        "array.json": [record(rng, 1000 + i) for i in range(16)],
        "others.json": {"Meta": [{"eventID": "no"}, {"x": [{"eventID": "no"}]}], "n": {"Records": [{"eventID": "no"}]}, "t": "\"Records\":[{",
                        "Records": [record(rng, 2000 + i) for i in range(12)] + [7, "text {", None, [{"eventID": "no"}], {"eventID": "last"}],
                        "After": [{"eventID": "no"}] * 20},
        "empty.json": {"Records": []}, "none.json": {"Records": None}, "list.json": [], "one.json": {"Records": [{"eventID": "only"}]},
    }
    for name, doc in docs.items():
        write(tmp_dir, name, json.dumps(doc, indent=indent, ensure_ascii=False))
    got = ranges.read_cloudtrail_ranges(spark, tmp_dir)
    assert rows(got) == rows(read_cloudtrail(spark, tmp_dir).where("source_file <> 'none.json' or event_id is not null"))
    assert len(rows(got)) == 24 + 16 + 13 + 1


def test_one_large_document_in_many_tasks(spark, tmp_dir):
    path = os.path.join(tmp_dir, "doc")
    fx.single_document(spark, SF, path)
    (name,) = [f for f in os.listdir(path) if f.endswith(".json")]
    size = os.path.getsize(os.path.join(path, name))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 12))
    try:
        assert ranges.stretches(spark, [path]).rdd.getNumPartitions() >= 12
        assert rows(ranges.read_cloudtrail_ranges(spark, path)) == rows(read_cloudtrail(spark, path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_writers_of_large_files_sort_nothing(spark, tmp_dir, monkeypatch):
    """A task that sorted what it writes would hold a whole document, or a whole day."""
    frame, writer, writers = type(spark.range(1)), type(spark.range(1).write), []
    key, text = "spark.sql.maxConcurrentOutputFileWriters", writer.text

    def sort(*a, **b):
        raise AssertionError("sorted")

    def write(self, path, *a, **b):
        writers.append(int(spark.conf.get(key)))
        return text(self, path, *a, **b)

    monkeypatch.setattr(frame, "sortWithinPartitions", sort)
    monkeypatch.setattr(writer, "text", write)
    before = spark.conf.get(key)
    fx.single_document(spark, SF, os.path.join(tmp_dir, "doc"))
    with open(os.path.join(tmp_dir, "doc", "document.json")) as f:
        doc = json.load(f)["Records"]
    events = fx.table(spark, SF, "events").count()
    assert doc[-1] is None and len({r["eventID"] for r in doc[:-1]}) == len(doc) - 1 == events
    root = fx.landed_archive(spark, SF)
    assert writers[1] > 0 and spark.conf.get(key) == before      # without writers side by side, Spark sorts by folder
    assert read_cloudtrail(spark, root, columns=["event_id"]).count() == events


def test_no_events_make_an_empty_document(spark, tmp_dir):
    fx.table(spark, SF, "events").limit(0).write.parquet(os.path.join(tmp_dir, "none", "events.parquet"))
    fx.single_document(spark, os.path.join(tmp_dir, "none"), os.path.join(tmp_dir, "doc"))
    assert read_cloudtrail(spark, os.path.join(tmp_dir, "doc")).count() == 0


def test_files_in_groups(spark, tmp_dir, small_ranges, monkeypatch):
    rng = random.Random(9)
    for n in range(4):
        write(tmp_dir, f"d{n}.json", json.dumps({"Records": [record(rng, 100 * n + i) for i in range(10)]}))
    monkeypatch.setattr(ranges, "MANY_RANGES", 3)
    assert rows(ranges.read_cloudtrail_ranges(spark, tmp_dir)) == rows(read_cloudtrail(spark, tmp_dir))


def test_a_document_that_breaks_off_keeps_its_records(spark, tmp_dir, small_ranges):
    rng = random.Random(2)
    text = json.dumps({"Records": [record(rng, i) for i in range(20)]})
    cut = text.index('"eventID": "e15"')
    write(tmp_dir, "broken.json", text[:cut])
    got = ranges.read_cloudtrail_ranges(spark, tmp_dir)
    assert sorted(r.event_id for r in got.collect()) == sorted(f"e{i}" for i in range(15))


@given(st.lists(st.text(alphabet='ab"\\', max_size=8), max_size=5), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_opening_finds_the_record(strings, gaps):
    doc = {f"{i}{s}": [s] for i, s in enumerate(strings)} | {"Records": [{"a": 1}]}
    text = (" " * gaps + json.dumps(doc)).encode()
    at, key = ranges.opening(text, 0, 2)
    assert text[at:at + 7] == b'{"a": 1' and json.loads(key) == "Records"
    assert ranges.opening(b" ,\n{", 2, 2) == (3, None) and ranges.opening(b"]}", 2, 2)[0] == -1
