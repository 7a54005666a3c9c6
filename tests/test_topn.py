"""Three-phase top-N against the plain aggregate."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift import fixtures as fx
from logsift.operators import cloudtrail as ct
from logsift.operators import s3 as s3a
from logsift.operators import topn, vpc
from logsift.operators.topn import TopGroups

SF = "/root/testdata/sf0.001"


def flows(spark, rows, parts=6):
    df = spark.createDataFrame(rows, "srcaddr string, dstaddr string, bytes long, packets long")
    return df.repartition(parts)


@pytest.mark.parametrize("n", [1, 20, 10_000])
def test_same_rows_as_the_plain_operators(spark, n):
    v, c, s = fx.vpc_frame(spark, SF).repartition(5), fx.ct_frame(spark, SF).repartition(5), fx.s3_frame(spark, SF).repartition(5)
    for fast, plain in [(topn.vpc_top_connections_tput(v, n), vpc.vpc_top_connections(v, n)), (topn.vpc_top_ips_tput(v, n), vpc.vpc_top_ips(v, n)),
                        (topn.ct_top_ips_tput(c, n), ct.ct_top_ips(c, n)), (topn.s3_requesters_tput(s, n), s3a.s3_requesters(s, n))]:
        assert fast.dtypes == plain.dtypes and fast.collect() == plain.collect()


def test_far_fewer_rows_are_sent(spark):
    """A long tail of pairs that every task holds, and some heavy ones spread over the tasks."""
    ids = spark.range(240_000)
    tail = ids.select(F.concat(F.lit("s"), F.col("id") % 30_000).alias("srcaddr"), F.lit("d").alias("dstaddr"),
                      (F.col("id") % 7).alias("bytes"), F.lit(1).cast("long").alias("packets"))
    heavy = ids.limit(4_000).select(F.concat(F.lit("h"), F.col("id") % 40).alias("srcaddr"), F.lit("d").alias("dstaddr"),
                                    (100 + F.col("id") % 40).alias("bytes"), F.lit(1).cast("long").alias("packets"))
    df = tail.union(heavy).repartition(8)
    groups = TopGroups(df, {"source_ip": F.col("srcaddr"), "destination_ip": F.col("dstaddr")},
                       {"total_bytes": ("sum", F.col("bytes")), "total_packets": ("sum", F.col("packets")), "flow_count": ("sum", F.lit(1))},
                       "total_bytes")
    assert groups.best(20).collect() == vpc.vpc_top_connections(df, 20).collect()
    assert groups.sent["every_group"] > 100_000
    assert groups.sent["phase_1"] + groups.sent["phase_2"] < groups.sent["every_group"] / 100 and groups.sent["survivors"] <= 40


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 2), st.one_of(st.none(), st.integers(0, 5))), max_size=60), st.integers(1, 6))
@settings(max_examples=12, deadline=None)
def test_ties_and_nulls(spark, rows, n):
    df = flows(spark, [(f"s{a}", f"d{b}", x, 1) for a, b, x in rows], 3)
    assert topn.vpc_top_connections_tput(df, n).collect() == vpc.vpc_top_connections(df, n).collect()


def test_sums_beyond_bigint_and_negative_measures(spark):
    big = (1 << 63) - 10
    rows = [("a", "x", big, 1), ("a", "x", big, 1), ("b", "x", big, 2), ("c", "x", 5, 3), ("0", "x", big, 1), ("0", "x", 11, 1)]
    df = flows(spark, rows, 2)
    assert topn.vpc_top_connections_tput(df, 3).collect() == vpc.vpc_top_connections(df, 3).collect()
    df = flows(spark, [("a", "x", -5, 1), ("b", "x", 3, 1), ("c", "x", None, 1), ("d", "x", -1, 1)], 2)
    assert topn.vpc_top_connections_tput(df, 3).collect() == vpc.vpc_top_connections(df, 3).collect()


def test_a_task_of_many_groups_writes_several_parts(spark, monkeypatch):
    monkeypatch.setattr(topn, "FOLD_GROUPS", 50)
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(400)}", f"d{rng.randrange(3)}", rng.randrange(100), 1) for _ in range(5_000)]
    df = flows(spark, rows, 2)
    assert topn.vpc_top_connections_tput(df, 7).collect() == vpc.vpc_top_connections(df, 7).collect()


def test_empty_input(spark):
    assert topn.vpc_top_connections_tput(fx.vpc_frame(spark, SF).where("false")).collect() == []
