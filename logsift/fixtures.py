"""Log-shaped views over the benchmark tables, for oracle checks and benchmarks.

The benchmark tables (``events``, ``lineitem``, ``orders``) contain no cloud
logs.  The three SQL views below derive CloudTrail-, VPC-Flow- and
S3-access-shaped rows from them (one output row per input row, so the work
grows with the tables).  The same text runs in Spark and in DuckDB: table
names are ``{events}``-style placeholders (Spark binds DataFrames to them;
for DuckDB they become the plain table names) and literal braces are doubled.

``ct_frame`` / ``vpc_frame`` / ``s3_frame`` then cast the view to the parsed
table schemas, and the ``*_raw_*`` builders render the rows back to raw log
text so the parsers can be checked end to end on derived data.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.common import epoch_seconds_to_ntz, parse_iso_utc, to_integer
from .operators.enrich import local_time
from .session import checkpoint_dir
from .sources.s3 import s3_time

CT_VIEW = """
SELECT e.event_id,
       replace(substr(CAST(e.ts AS STRING), 1, 19), ' ', 'T') || 'Z' AS event_time_text,
       r.region AS aws_region,
       n.name   AS event_name,
       CASE WHEN e.event_id % 101 = 0 THEN NULL ELSE '10.0.' || CAST(e.user_id % 4 AS STRING) || '.' || CAST(e.user_id AS STRING) END AS source_ip,
       u.ua     AS user_agent,
       x.code   AS error_code,
       x.msg    AS error_message,
       CASE WHEN e.user_id % 10 = 0 THEN NULL WHEN e.user_id % 37 = 0 THEN 'Unknown' ELSE 'user_' || CAST(e.user_id AS STRING) END AS user_name,
       'arn:aws:iam::123456789012:user/user_' || CAST(e.user_id AS STRING) AS arn,
       CASE WHEN n.name = 'CreateUser' AND e.event_id % 2 = 0 THEN '{{"userName":"new_' || CAST(e.event_id AS STRING) || '"}}' END AS request_parameters
FROM {events} e
LEFT JOIN (VALUES (0,'us-east-1'),(1,'us-west-2'),(2,'ap-northeast-2'),(3,'ap-south-1'),(4,'sa-east-1'),(5,'eu-west-1'),(6,'eu-south-1')) AS r(i, region) ON e.user_id % 8 = r.i
LEFT JOIN (VALUES (0,'ConsoleLogin'),(1,'CreateUser'),(2,'AssumeRole'),(3,'GetObject'),(4,'PutObject'),(5,'DisableKey'),(6,'GetPasswordData'),(7,'AuthorizeSecurityGroupIngress'),(8,'ListUsers'),(9,'DescribeInstances'),(10,'StopLogging'),(11,'RunInstances'),(12,'SendCommand'),(13,'LookupEvents'),(14,'DescribeAlarms'),(15,'LoginFailed'),(16,'ConsoleLogin')) AS n(i, name) ON e.event_id % 18 = n.i
LEFT JOIN (VALUES (0,'aws-cli/2.1 Python/3.9'),(1,'aws-sdk-go/1.44'),(2,'Mozilla/5.0 Chrome/120'),(3,'Mozilla/5.0 Firefox/118'),(4,'console.amazonaws.com'),(5,'Boto3/1.28 python/3.11'),(6,'curl/8.0'),(7,'aws-internal/3'),(8,'Terraform/1.5'),(9,'okhttp android'),(10,'')) AS u(i, ua) ON (e.event_id * 7) % 13 = u.i
LEFT JOIN (VALUES (0,'AccessDenied','not authorized'),(1,'Client.UnauthorizedOperation','denied'),(2,'InvalidAccessKeyId','bad key'),(3,'ExpiredTokenException','The security token is expired'),(4,NULL,'SignatureDoesNotMatch; AccessDenied'),(5,'ThrottlingException','slow down')) AS x(i, code, msg) ON e.event_id % 29 = x.i
"""

VPC_VIEW = """
SELECT l_orderkey, l_linenumber,
       '10.1.' || CAST(l_suppkey % 8 AS STRING) || '.' || CAST(l_suppkey % 50 AS STRING) AS srcaddr,
       CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN '-' ELSE '10.2.0.' || CAST(l_partkey % 200 AS STRING) END AS dstaddr,
       CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN '-' ELSE CAST(1024 + l_partkey % 5000 AS STRING) END AS srcport,
       CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN '-' ELSE p.port END AS dstport,
       CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN '-' ELSE q.proto END AS protocol,
       CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN '-' ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) END AS packets,
       CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN '-' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END AS bytes,
       1704067200 + (l_orderkey * 97 + l_linenumber * 3607 + l_partkey * 13) % 2592000 AS start_epoch,
       1704067200 + (l_orderkey * 97 + l_linenumber * 3607 + l_partkey * 13) % 2592000 + (l_suppkey * 7) % 600 AS end_epoch,
       CASE WHEN l_returnflag = 'R' THEN 'REJECT' ELSE 'ACCEPT' END AS action,
       CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN 'NODATA' ELSE 'OK' END AS flow_log_status
FROM {lineitem}
LEFT JOIN (VALUES (0,'22'),(1,'443'),(2,'3389'),(3,'80'),(4,'445'),(5,'53'),(6,'5900'),(7,'8080'),(8,'21'),(9,'3306'),(10,'23')) AS p(i, port) ON l_partkey % 11 = p.i
LEFT JOIN (VALUES (0,'6'),(1,'6'),(2,'17'),(3,'1'),(4,'58')) AS q(i, proto) ON l_suppkey % 5 = q.i
"""

S3_VIEW = """
SELECT o_orderkey, '79a59df900b949e5' AS bucket_owner, 'bkt-' || CAST(o_custkey % 5 AS STRING) AS bucket,
       '[' || lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0') || '/Oct/2025:' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS STRING), 2, '0') || CASE WHEN o_orderkey % 13 = 0 THEN ' +0930]' WHEN o_orderkey % 13 = 1 THEN ' -0500]' ELSE ' +0000]' END AS original_timestamp,
       CASE WHEN o_orderkey % 53 = 0 THEN '-' ELSE '203.0.113.' || CAST(o_custkey % 40 AS STRING) END AS remote_ip,
       CASE o_custkey % 6 WHEN 0 THEN '-' WHEN 1 THEN 'arn:aws:iam::123456789012:user/u' || CAST(o_custkey % 30 AS STRING)
            WHEN 2 THEN 'arn:aws:sts::123456789012:assumed-role/admin/s' || CAST(o_custkey % 7 AS STRING)
            WHEN 3 THEN 'svc:cloudtrail.amazonaws.com' WHEN 4 THEN '198.51.100.' || CAST(o_custkey % 9 AS STRING) ELSE '5043e0a2f5c9' END AS requester,
       'REQ' || CAST(o_orderkey AS STRING) AS request_id,
       op.op AS operation,
       CASE WHEN o_orderkey % 41 = 0 THEN '-' WHEN o_orderkey % 23 = 0 THEN '/data/archive-of-many-long-folder-names/and-another-one/' || CAST(o_custkey % 25 AS STRING) || '.bin' ELSE '/data/' || CAST(o_custkey % 25 AS STRING) || '.bin' END AS object_key,
       ua.ua AS user_agent, CAST(floor(o_totalprice) AS BIGINT) AS bytes_sent
FROM {orders}
JOIN (VALUES (0,'REST.GET.OBJECT'),(1,'REST.PUT.OBJECT'),(2,'REST.DELETE.OBJECT'),(3,'REST.COPY.OBJECT'),(4,'REST.HEAD.BUCKET'),(5,'REST.OPTIONS.PREFLIGHT'),(6,'REST.GET.ACL'),(7,'REST.PUT.ACL'),(8,'REST.GET.BUCKETPOLICY'),(9,'REST.GET.WEBSITE'),(10,'S3.EXPIRE.OBJECT')) AS op(i, op) ON o_orderkey % 11 = op.i
JOIN (VALUES (0,'-'),(1,'aws-cli/2.1'),(2,'Mozilla/5.0 Safari/605'),(3,'Dalvik Android'),(4,'AmazonS3/1'),(5,'curl/8.0'),(6,'Boto3 python'),(7,'Ruby')) AS ua(i, ua) ON (o_orderkey * 3) % 8 = ua.i
"""

VIEWS = {"ct": (CT_VIEW, "events"), "vpc": (VPC_VIEW, "lineitem"), "s3": (S3_VIEW, "orders")}


def view_sql_for_duckdb(name: str) -> str:
    """The view text with plain table names, for use as a DuckDB CTE body."""
    text, table = VIEWS[name]
    return text.format(**{table: table})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Raw-log renderers stand in for many delivered log files, which a real
    scan reads in parallel.  Each benchmark table is a single Parquet row group
    (one scan task), so rows are spread round-robin when the scan has fewer
    partitions than the session's parallelism, letting the parsers use every
    core.  A no-op when the input already has enough partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = False) -> DataFrame:
    """One of ``ct``, ``vpc``, ``s3`` as a Spark DataFrame over the sf_dir tables."""
    text, tbl = VIEWS[name]
    t = table(spark, sf_dir, tbl)
    return spark.sql(text, **{tbl: spread(t) if spread_rows else t})


# ---------------------------------------------------------------------------
# typed frames (parsed-table schemas)
# ---------------------------------------------------------------------------

def ct_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``ct`` view as a parsed ``cloudtrail`` table (identity map + columns)."""
    v = view(spark, sf_dir, "ct")
    identity = F.map_from_arrays(
        F.array(F.lit("type"), F.lit("arn"), F.lit("accountId"), F.lit("userName")),
        F.array(F.lit("IAMUser"), F.col("arn"), F.lit("123456789012"), F.col("user_name")))
    return v.select(
        parse_iso_utc("event_time_text").alias("event_time"),
        local_time(parse_iso_utc("event_time_text"), F.col("aws_region")).alias("event_time_local"),
        "aws_region", "event_name", F.lit("iam.amazonaws.com").alias("event_source"),
        F.col("source_ip").alias("source_ip_address"), F.nullif("user_agent", F.lit("")).alias("user_agent"),
        identity.alias("user_identity"), F.col("request_parameters").alias("request_elements"),
        F.lit(None).cast("string").alias("response_elements"), F.lit("AwsApiCall").alias("event_type"),
        F.col("event_id").cast("string").alias("event_id"), "error_code", "error_message",
        F.lit("IAMUser").alias("user_type"), F.lit(None).cast("string").alias("principal_id"),
        F.col("arn").alias("user_arn"), F.lit("123456789012").alias("account_id"), "user_name",
        F.lit("ct_view").alias("source_file"),
    )


def vpc_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``vpc`` view as a parsed ``vpc_flow`` table."""
    v = view(spark, sf_dir, "vpc")
    return v.select(
        F.lit("2").alias("version"), F.lit("123456789012").alias("account_id"),
        F.lit("eni-0a1b2c3d").alias("interface_id"), "srcaddr", "dstaddr",
        *[to_integer(c).alias(c) for c in ("srcport", "dstport", "protocol", "packets", "bytes")],
        epoch_seconds_to_ntz("start_epoch").alias("window_start"),
        epoch_seconds_to_ntz("end_epoch").alias("window_end"),
        "action", "flow_log_status", F.lit("vpc_view").alias("source_file"),
    )


def s3_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``s3`` view as a parsed ``s3_access`` table."""
    v = view(spark, sf_dir, "s3")
    return v.select(
        "bucket_owner", "bucket", "original_timestamp", s3_time("original_timestamp").alias("request_datetime"),
        "remote_ip", "requester", "request_id", "operation", F.col("object_key").alias("key"),
        F.concat(F.lit("GET "), F.col("object_key"), F.lit(" HTTP/1.1")).alias("request_uri"),
        F.lit(200).alias("http_status_code"), F.lit("-").alias("error_code"), "bytes_sent",
        "user_agent", F.lit("s3_view").alias("source_file"),
    )


# ---------------------------------------------------------------------------
# raw log text rendered from the views (parser round trips)
# ---------------------------------------------------------------------------

VPC_HEADER = ("version account-id interface-id srcaddr dstaddr srcport dstport protocol packets bytes "
              "start end action log-status")


def vpc_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(value, source_file)`` flow-log lines: one record per view row; the row of
    each order's first line item also emits a header line, a comment line, a
    short (truncated) line and a blank line, which the parser must drop.
    Single pass over the view (a generator, no union or shuffle)."""
    v = view(spark, sf_dir, "vpc", spread_rows=True)
    record = F.concat_ws(" ", F.lit("2"), F.lit("123456789012"), F.lit("eni-0a1b2c3d"), "srcaddr", "dstaddr",
                         "srcport", "dstport", "protocol", "packets", "bytes", F.col("start_epoch").cast("string"),
                         F.col("end_epoch").cast("string"), "action", "flow_log_status")
    junk = [F.lit(VPC_HEADER), F.lit("# comment"), F.lit("2 123456789012 eni-x 10.0.0.1"), F.lit("   ")]
    lines = F.when(F.col("l_linenumber") == 1, F.array(*junk, record)).otherwise(F.array(record))
    return v.select(F.explode(lines).alias("value"),
                    F.format_string("flow-%03d.log", F.col("l_orderkey") % 64).alias("source_file"))


def s3_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(value, source_file)`` access-log lines.  Rows whose user agent is ``-`` are
    written in the short unquoted form, which takes the fallback tokeniser; some of
    the others carry two fields appended to the format, and some rows come with a
    blank line and a comment."""
    v = view(spark, sf_dir, "s3", spread_rows=True).withColumn("source_file", F.format_string("access-%02d.log", F.col("o_orderkey") % 16))
    uri = F.concat(F.lit('"GET '), F.col("object_key"), F.lit(' HTTP/1.1"'))
    full = F.concat_ws(" ", "bucket_owner", "bucket", "original_timestamp", "remote_ip", "requester", "request_id",
                       "operation", "object_key", uri, F.lit("200"), F.lit("-"), F.col("bytes_sent").cast("string"),
                       F.lit("-"), F.lit("-"), F.lit("-"), F.lit('"-"'),
                       F.concat(F.lit('"'), F.col("user_agent"), F.lit('"')), F.lit("-"), F.lit("HOSTID"),
                       F.lit("SigV4"), F.lit("ECDHE-RSA-AES128-GCM-SHA256"), F.lit("AuthHeader"),
                       F.lit("s3.amazonaws.com"), F.lit("TLSv1.2"), F.lit("-"), F.lit("-"))
    short = F.concat_ws(" ", "bucket_owner", "bucket", "original_timestamp", "remote_ip", "requester", "request_id",
                        "operation", "object_key", F.lit("-"), F.lit("200"), F.lit("-"),
                        F.col("bytes_sent").cast("string"))
    full = F.when(F.col("o_orderkey") % 19 == 0, F.concat(full, F.lit(' new1 "new 2"'))).otherwise(full)
    line = F.when(F.col("user_agent") == "-", short).otherwise(full)
    lines = F.when(F.col("o_orderkey") % 29 == 0, F.array(F.lit("  "), F.lit("# comment"), line)).otherwise(F.array(line))
    return v.select(F.explode(lines).alias("value"), "source_file")


def odd_vpc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-log lines of every view row, where some have times in microseconds or with 17 or
    25 digits, and some byte counts near the limit of bigint."""
    v = view(spark, sf_dir, "vpc", spread_rows=True)
    odd = F.col("l_orderkey") % 7
    start = (F.when(odd == 0, F.concat(F.col("start_epoch"), F.lit("000000"))).when(odd == 1, F.lit("9" * 17))
             .when(odd == 2, F.lit("9" * 25)).otherwise(F.col("start_epoch").cast("string")))
    size = F.when(F.col("l_orderkey") % 11 == 0, F.lit("9223372036854775000")).otherwise(F.col("bytes"))
    line = F.concat_ws(" ", F.lit("2"), F.lit("123456789012"), F.lit("eni-0a1b2c3d"), "srcaddr", "dstaddr", "srcport", "dstport",
                       "protocol", "packets", size, start, F.col("end_epoch").cast("string"), "action", "flow_log_status")
    return v.select(line.alias("value"), F.lit("odd.log").alias("source_file"))


def landing_folder(spark: SparkSession, label: str) -> str:
    """A new folder for files that a query writes and reads back, on the shared storage of the session."""
    return f"{checkpoint_dir(spark)}/logsift-{label}-{uuid.uuid4().hex}"


def landed_text(lines: DataFrame, label: str, compression: str = "none") -> str:
    """Raw lines as text files (``.txt``, ``.txt.gz``); returns the folder."""
    path = landing_folder(lines.sparkSession, label)
    lines.select("value").write.option("compression", compression).text(path)
    return path


def landed_json(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """CloudTrail records as JSON-Lines files named ``.json`` or ``.json.gz``; returns the folder."""
    path = landing_folder(spark, "ct")
    ct_raw_records(spark, sf_dir).select("rec.*").write.option("compression", compression).json(path)
    return path


def landed_archive(spark: SparkSession, sf_dir: str) -> str:
    """CloudTrail records as JSON-Lines files named ``.json.gz`` in an archive by account, region and event day; returns its root."""
    recs = ct_raw_records(spark, sf_dir).select("rec.*")
    day = F.split(F.substring("eventTime", 1, 10), "-")
    folder = landing_folder(spark, "days")
    dated = recs.withColumns({"__y": day[0], "__m": day[1], "__d": day[2]}).repartition("__y", "__m", "__d")
    texts = dated.select("__y", "__m", "__d", F.to_json(F.struct(*recs.columns)).alias("value"))
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")            # a task's days are written side by side, their rows unsorted
    try:
        texts.write.option("compression", "gzip").partitionBy("__y", "__m", "__d").text(folder)
    finally:
        spark.conf.set(key, before)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(hadoop.Path(f"{folder}/__y=*/__m=*/__d=*/part-*")):
        *_, y, m, d, _ = part.getPath().toString().split("/")
        target = "/".join([folder, "AWSLogs/123456789012/CloudTrail/us-east-1", *[x.split("=")[1] for x in (y, m, d)]])
        files.mkdirs(hadoop.Path(target))
        # a day was written by one task
        files.rename(part.getPath(), hadoop.Path(f"{target}/trail-{''.join(x.split('=')[1] for x in (y, m, d))}.json.gz"))
    return f"{folder}/AWSLogs"


def single_document(spark: SparkSession, sf_dir: str, path: str) -> None:
    """All CloudTrail records as one ``Records`` document (``.json``), which one task writes as they come; its last value is a null."""
    recs = ct_raw_records(spark, sf_dir).select(F.concat(F.to_json("rec"), F.lit(",")).alias("value"))
    folder = landing_folder(spark, "document")

    def framed(batches):
        yield pa.record_batch([pa.array(['{"Records":['])], names=["value"])
        for b in batches:
            yield pa.record_batch([b.column("value").drop_null()], names=["value"])
        yield pa.record_batch([pa.array(["null]}"])], names=["value"])

    # a row without a value, so that there is a task if there are no records
    nothing = spark.range(1).select(F.lit(None).cast("string").alias("value"))
    recs.union(nothing).repartition(1).mapInArrow(framed, "value string").write.text(folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(path))
    part = [f.getPath() for f in files.listStatus(hadoop.Path(folder)) if f.getPath().getName().startswith("part-")]
    files.rename(part[0], hadoop.Path(f"{path}/document.json"))


def ct_raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``ct`` view as CloudTrail record structs (``rec``) with a file name."""
    v = view(spark, sf_dir, "ct", spread_rows=True)
    identity = F.struct(F.lit("IAMUser").alias("type"), F.col("arn").alias("arn"),
                        F.lit("123456789012").alias("accountId"), F.col("user_name").alias("userName"),
                        F.struct(F.struct(F.lit("false").alias("mfaAuthenticated")).alias("attributes"))
                        .alias("sessionContext"))
    rec = F.struct(
        F.lit("1.08").alias("eventVersion"), identity.alias("userIdentity"),
        F.col("event_time_text").alias("eventTime"), F.lit("iam.amazonaws.com").alias("eventSource"),
        F.col("event_name").alias("eventName"), F.col("aws_region").alias("awsRegion"),
        F.col("source_ip").alias("sourceIPAddress"), F.col("user_agent").alias("userAgent"),
        F.col("error_code").alias("errorCode"), F.col("error_message").alias("errorMessage"),
        F.when(F.col("request_parameters").isNotNull(),
               F.struct(F.get_json_object("request_parameters", "$.userName").alias("userName")))
        .alias("requestParameters"),
        F.col("event_id").cast("string").alias("eventID"), F.lit(True).alias("readOnly"),
        F.lit("AwsApiCall").alias("eventType"), F.lit(True).alias("managementEvent"),
        F.lit("123456789012").alias("recipientAccountId"), F.lit("Management").alias("eventCategory"),
    )
    return v.select(rec.alias("rec"), F.format_string("ct-%04d.json", (F.col("event_id") / 50).cast("long"))
                    .alias("source_file"), "event_id")


def ct_raw_documents(spark: SparkSession, sf_dir: str, shape: str = "records") -> DataFrame:
    """``(value, source_file)`` CloudTrail documents built from the ``ct`` view.

    ``shape``: ``records`` (``{"Records": [...]}`` per file of 50 events),
    ``jsonl`` (one record per line, plus a broken line per file), ``array``,
    ``single`` (one record object per file), ``dupkeys`` (every record has a
    repeated key whose last value counts) or ``bad_record`` (a ``Records`` array
    that also holds a number, a text and a null).
    Grouping is by file, and a file holds at most 50 events, so every group is
    bounded.
    """
    r = ct_raw_records(spark, sf_dir)
    if shape == "jsonl":
        # each file ends with one broken line, which the parser must skip
        lines = r.select(F.to_json("rec").alias("line"), "source_file")
        doc = F.concat(F.array_join(F.collect_list("line"), "\n"), F.lit("\n{not json"))
        return (lines.groupBy("source_file").agg(doc.alias("value"))
                .select("value", F.regexp_replace("source_file", r"\.json$", ".jsonl").alias("source_file")))
    if shape == "single":
        return r.select(F.to_json("rec").alias("value"), F.format_string("ct-%d.json", "event_id").alias("source_file"))
    if shape in ("dupkeys", "bad_record"):
        rec = F.to_json("rec")
        if shape == "dupkeys":
            rec = F.concat(F.lit('{"eventID":"overridden","eventTime":"2000-01-01T00:00:00Z",'), F.substring(rec, 2, 1 << 30))
        texts = r.select(rec.alias("rec"), "source_file").groupBy("source_file").agg(F.array_join(F.collect_list("rec"), ",").alias("recs"))
        tail = ',7,"text",null]}' if shape == "bad_record" else "]}"
        return texts.select(F.concat(F.lit('{"Records":['), "recs", F.lit(tail)).alias("value"), "source_file")
    grouped = r.groupBy("source_file").agg(F.collect_list("rec").alias("recs"))
    if shape == "array":
        return grouped.select(F.to_json("recs").alias("value"), "source_file")
    return grouped.select(F.to_json(F.struct(F.col("recs").alias("Records"))).alias("value"), "source_file")
