"""Results must not depend on how a scan is split, which changes when executors come or go."""

import contextlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logsift.llm import exact, hilbert, simhash, suffix
from logsift.llm.common import numbered, table

SPLITS = ["spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"]


@contextlib.contextmanager
def split(spark, *values):
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    try:
        for k, v in zip(SPLITS, values):
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """The documents in several row groups of several files."""
    path = str(tmp_path_factory.mktemp("many") / "documents.parquet")
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    docs.repartition(3).write.option("parquet.block.size", 100_000).parquet(path)
    return path


OPERATORS = {
    "op3": suffix.op3, "drop_repeats": suffix.drop_repeats, "keep_distinct": exact.keep_distinct, "keep_first": simhash.keep_first,
    "good_quality": lambda d: corpus_pipeline.good_quality(d.sparkSession, d, "/root/testdata/sf0.01"),
}


@pytest.mark.parametrize("frame", ["table", "shuffled"])
@pytest.mark.parametrize("name", OPERATORS)
def test_split_changes_between_building_and_running(spark, many, name, frame):
    docs = spark.read.parquet(many)
    if frame == "shuffled":
        docs = docs.repartition(5).where("doc_id % 2 = 0")
    with split(spark, "1", "4194304", "134217728"):
        out = OPERATORS[name](docs)
        want = sorted(map(tuple, out.collect()))
    with split(spark, "1", "4194304", "134217728"):
        out = OPERATORS[name](docs)
    with split(spark, "40", "1024", "30000"):
        assert sorted(map(tuple, out.collect())) == want and len(want) > 100


def test_write_shards_after_a_changed_split(spark, many, tmp_path):
    docs = spark.read.parquet(many)
    with split(spark, "40", "1024", "30000"):
        hilbert.write_shards(docs, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


def test_numbers_of_other_frames(spark, many):
    docs = spark.read.parquet(many)
    for frame in (docs, docs.union(docs), docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("twice")), docs.where(F.rand() < 2)):
        rows = numbered(frame, "number")
        assert rows.columns == [*frame.columns, "number"]
        assert rows.select("number").distinct().count() == frame.count() == rows.count()
