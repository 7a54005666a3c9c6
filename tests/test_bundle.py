"""Bundles, sinks and loaders: write, re-read, original CSV layout."""

import os

from pyspark.sql import functions as F

from logsift import fixtures as fx
from logsift.plans import bundle
from logsift.sources.parsed import load_parsed

SF = "/root/testdata/sf0.001"


def test_run_analysis_and_write_bundle(spark, tmp_dir):
    tables = bundle.run_analysis(fx.vpc_frame(spark, SF), "vpc")
    assert list(tables)[:5] == bundle.VPC_TABLES
    written = bundle.write_bundle(tables, tmp_dir, "vpc")
    back = spark.read.parquet(written["Connection_Statistics_(Top_20)"])
    assert back.count() == 20
    ct_tables = bundle.run_analysis(fx.ct_frame(spark, SF), "cloudtrail", as_of="2024-01-31")
    assert list(ct_tables)[:11] == bundle.CLOUDTRAIL_TABLES
    out = bundle.write_bundle({"Mitre_ATTACK_Events": ct_tables["Mitre_ATTACK_Events"]}, tmp_dir, "cloudtrail")
    parts = {d for d in os.listdir(out["Mitre_ATTACK_Events"]) if d.startswith("tactic=")}
    assert "tactic=Persistence" in parts
    n_direct = ct_tables["Mitre_ATTACK_Events"].count()
    assert spark.read.parquet(out["Mitre_ATTACK_Events"]).count() == n_direct
    s3_tables = bundle.run_analysis(fx.s3_frame(spark, SF), "s3", materialization=None)
    csv = bundle.write_bundle(s3_tables, tmp_dir, "s3", fmt="csv")
    assert spark.read.option("header", True).csv(csv["Operation_Statistics"]).count() == 20


def test_run_summary(spark):
    s = bundle.run_summary(spark, {"cloudtrail": fx.ct_frame(spark, SF), "vpc": None,
                                   "s3": fx.s3_frame(spark, SF).limit(0)})
    got = {r.log_type: (r.status, r.parsed_events) for r in s.collect()}
    assert got["vpc"] == ("skipped", 0) and got["s3"] == ("no data", 0) and got["cloudtrail"][0] == "ok"


def test_export_order_and_csv_round_trip(spark, tmp_dir):
    ct_df = fx.ct_frame(spark, SF)
    exp = bundle.export_frame(ct_df, "cloudtrail")
    cols = exp.columns
    assert cols[:9] == ["eventTime", "eventTimeLocal", "awsRegion", "eventName", "eventSource", "sourceIpAddress",
                        "userAgent", "requestElements", "responseElements"]
    ident = [c for c in cols if c.startswith("userIdentity.")]
    assert cols[9:9 + len(ident)] == ident and cols[-1] == "sourceFile"
    path = os.path.join(tmp_dir, "ct_csv")
    bundle.export_ordered(ct_df, "cloudtrail", path)
    back = load_parsed(spark, path, "cloudtrail", fmt="csv")
    assert back.count() == ct_df.count()
    a = sorted((r.event_id, str(r.event_time), str(r.event_time_local), r.user_name)
               for r in ct_df.select("event_id", "event_time", "event_time_local", "user_name").collect())
    b = sorted((r.event_id, str(r.event_time), str(r.event_time_local), r.user_name)
               for r in back.select("event_id", "event_time", "event_time_local", "user_name").collect())
    assert a == b


def test_write_parsed_partitioned(spark, tmp_dir):
    path = os.path.join(tmp_dir, "vpc_parsed")
    df = fx.vpc_frame(spark, SF)
    bundle.write_parsed(df, path, "vpc")
    back = load_parsed(spark, path, "vpc")
    assert back.count() == df.count()
    one_day = back.filter(F.col("event_date") == "2024-01-05")
    assert "PartitionFilters: [isnotnull(event_date" in one_day._jdf.queryExecution().executedPlan().toString()


def test_legacy_vpc_and_s3_csv(spark, tmp_dir):
    vpc_csv = os.path.join(tmp_dir, "vpc.csv")
    with open(vpc_csv, "w") as fh:
        fh.write("window_start,window_end,srcaddr,dstaddr,srcport,dstport,protocol,action,packets,bytes,sourceFile\n")
        fh.write("2025-10-01 00:00:00 (UTC+0),2025-10-01 00:01:00 (UTC+0),a,b,1,22,6,ACCEPT,-,10,f.log\n")
    r = load_parsed(spark, vpc_csv, "vpc", fmt="csv").first()
    assert str(r.window_start) == "2025-10-01 00:00:00" and r.packets is None and r.bytes == 10
    s3_csv = os.path.join(tmp_dir, "s3.csv")
    with open(s3_csv, "w") as fh:
        fh.write("request_datetime,operation,requester,sourceFile\n")
        fh.write("[01/Oct/2025:11:55:11 +0000],REST.GET.OBJECT,-,f.log\n")
    r = load_parsed(spark, s3_csv, "s3", fmt="csv").first()
    assert str(r.request_datetime) == "2025-10-01 11:55:11" and r.source_file == "f.log"


def test_checkpoint_materialization_matches_lazy(spark):
    from logsift.session import checkpoint_dir
    lazy = bundle.run_analysis(fx.vpc_frame(spark, SF), "vpc", materialization=None)
    ckpt = bundle.run_analysis(fx.vpc_frame(spark, SF), "vpc", materialization="checkpoint")
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    for name in bundle.VPC_TABLES:
        assert sorted(lazy[name].collect()) == sorted(ckpt[name].collect())


def test_listing_write_rebalances_files(spark, tmp_dir):
    import glob

    from logsift.functions.common import epoch_seconds_to_ntz
    n = 60_000
    df = (spark.range(n, numPartitions=12)
          .select(F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("T"), (F.col("id") % 5).cast("string")))
                  .alias("tactic"), F.col("id").cast("string").alias("request_id"),
                  epoch_seconds_to_ntz(F.col("id")).alias("request_datetime")))
    counts = {r.tactic: r["count"] for r in df.groupBy("tactic").count().collect()}
    plain = bundle.write_bundle({"Mitre_ATTACK_Events": df}, tmp_dir + "/plain", "s3", rebalance=False)
    rebal = bundle.write_bundle({"Mitre_ATTACK_Events": df}, tmp_dir + "/rebal", "s3")
    n_plain = len(glob.glob(plain["Mitre_ATTACK_Events"] + "/tactic=*/*.parquet"))
    n_rebal = len(glob.glob(rebal["Mitre_ATTACK_Events"] + "/tactic=*/*.parquet"))
    assert n_plain == 12 * len(counts) and n_rebal < n_plain
    back = spark.read.parquet(rebal["Mitre_ATTACK_Events"])
    assert {r.tactic: r["count"] for r in back.groupBy("tactic").count().collect()} == counts


def test_write_parsed_rebalance_bounds_files(spark, tmp_dir):
    import glob

    from logsift.functions.common import epoch_seconds_to_ntz
    from logsift.schemas import VPC_SCHEMA
    # every task holds every date: 12 tasks x 6 dates
    rows = spark.range(24_000, numPartitions=12).select(
        epoch_seconds_to_ntz(F.lit(1_700_000_000) + (F.col("id") % 6) * 86_400).alias("window_start"),
        F.col("id").cast("string").alias("srcaddr"))
    df = rows.select(*[rows[f.name] if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in VPC_SCHEMA.fields])
    bundle.write_parsed(df, tmp_dir + "/plain", "vpc", rebalance=False)
    bundle.write_parsed(df, tmp_dir + "/rebal", "vpc")
    n_plain = len(glob.glob(tmp_dir + "/plain/event_date=*/*.parquet"))
    n_rebal = len(glob.glob(tmp_dir + "/rebal/event_date=*/*.parquet"))
    assert n_plain == 72 and n_rebal < n_plain
    back = load_parsed(spark, tmp_dir + "/rebal", "vpc")
    assert back.count() == 24_000 and back.select("event_date").distinct().count() == 6
