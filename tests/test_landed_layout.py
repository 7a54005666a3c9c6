"""Landed tables: night filters and point lookups read a part of the files, with the same results."""

import os

from pyspark.sql import functions as F

from logsift import fixtures as fx
from logsift.functions.common import HOUR_COLUMN
from logsift.operators import cloudtrail as ct
from logsift.operators import vpc
from logsift.plans import bundle
from logsift.sources.parsed import load_parsed

SF = "/root/testdata/sf0.01"
SMALL = {"parquet.block.size": "20000", "parquet.page.size": "2000", "parquet.block.size.row.check.min": "50",
         "parquet.page.row.count.limit": "100"}


def rows_read(df):
    """The rows that the scan of an executed frame put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        elif name.startswith("Scan parquet"):
            total += p.metrics().apply("numOutputRows").value()
        else:
            children = p.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


def landed(spark, folder, log_type, frame, **options):
    path = os.path.join(folder, log_type)
    bundle.write_parsed(frame, path, log_type, options=SMALL, **options)
    return load_parsed(spark, path, log_type)


def test_a_night_filter_reads_the_night(spark, tmp_dir):
    # all on one day, so that its rows fill many row groups
    events = fx.ct_frame(spark, SF).withColumns({c: F.concat(F.lit("2024-01-01 "), F.date_format(c, "HH:mm:ss")).cast("timestamp_ntz")
                                                 for c in ("event_time", "event_time_local")})
    table = landed(spark, tmp_dir, "cloudtrail", events)
    fast = ct.ct_night_ips(table)
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert f"PushedFilters: [Or(GreaterThanOrEqual({HOUR_COLUMN},22),LessThan({HOUR_COLUMN},6))" in plan
    assert fast.collect() == ct.ct_night_ips(events).collect()
    assert rows_read(fast) < 0.5 * events.count()
    assert ct.ct_night_events(table).collect() == ct.ct_night_events(events).collect()
    flows = fx.vpc_frame(spark, "/root/testdata/sf0.001")
    assert vpc.vpc_night_remote(landed(spark, tmp_dir, "vpc", flows)).collect() == vpc.vpc_night_remote(flows).collect()


def test_a_point_lookup_reads_few_row_groups(spark, tmp_dir):
    # one value in a few places of a table of many distinct ones
    events = fx.ct_frame(spark, SF).withColumn("source_ip_address", F.concat(F.lit("10.9."), F.col("event_id")))
    one = events.where("event_id = '4242'").select("source_ip_address").first()[0]
    table = landed(spark, tmp_dir, "cloudtrail", events)
    got = ct.events_of(table, "source_ip_address", [one])
    assert [r.event_id for r in got.collect()] == ["4242"]
    assert rows_read(got) < 0.25 * events.count()
    plain = os.path.join(tmp_dir, "plain")
    bundle.write_parsed(events, plain, "cloudtrail", options=SMALL, bloom=False)
    assert rows_read(ct.events_of(load_parsed(spark, plain, "cloudtrail"), "source_ip_address", [one])) >= rows_read(got)
