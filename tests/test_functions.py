"""Scalar functions, lookups and rule order."""

from pyspark.sql import functions as F

from logsift.functions.classify import classify_user_agent, classify_user_agent_coarse, split_requester
from logsift.functions.common import night_window, pct
from logsift.operators.enrich import protocol_name, tactic_lookup
from logsift.operators.report import duration_hours


def _one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_pct_half_even_and_golden_report(spark):
    # percentages of the sample S3 report (259 records)
    rows = [(140, 259), (93, 259), (26, 259), (55, 259), (41, 259), (36, 259), (20, 259), (15, 259),
            (13, 259), (12, 259), (5, 259), (2, 259), (1, 259), (1, 8), (3, 8), (0, 5)]
    got = _one(spark, pct("n", "t"), "n long, t long", rows)
    assert got == [54.05, 35.91, 10.04, 21.24, 15.83, 13.9, 7.72, 5.79, 5.02, 4.63, 1.93, 0.77, 0.39,
                   12.5, 37.5, 0.0]
    # exact ties go to even: 1/800 = 0.125 % -> 0.12, 3/800 = 0.375 % -> 0.38
    assert _one(spark, pct("n", "t"), "n long, t long", [(1, 800), (3, 800)]) == [0.12, 0.38]
    assert _one(spark, pct("n", "t"), "n long, t long", [(1, 0)]) == [None]


def test_night_window(spark):
    hours = [(h,) for h in [None, 0, 5, 6, 7, 21, 22, 23]]
    assert _one(spark, night_window("h"), "h int", hours) == [False, True, True, False, False, False, True, True]
    assert _one(spark, night_window("h", inclusive_end=True), "h int", hours) == [
        False, True, True, True, False, False, True, True]


def test_detailed_user_agent_rules(spark):
    cases = {
        None: "Unknown/Empty", "": "Unknown/Empty", "aws-cli/2.1 Python/3.9": "AWS CLI (Python)",
        "aws-cli/1 java": "AWS CLI (Java)", "aws-cli/2": "AWS CLI (Other)", "aws-sdk-go/1.44": "AWS SDK (Go)",
        "aws-sdk-js node": "AWS SDK (JavaScript/Node.js)", "aws-sdk-dotnet": "AWS SDK (.NET)",
        "aws-sdk-x": "AWS SDK (Other)", "Mozilla/5.0 Firefox/118": "Browser (Firefox)",
        "Mozilla/5.0 Chrome/120": "Browser (Chrome)", "Mozilla/5.0": "Browser (Mozilla-based)",
        "Safari/605": "Browser (Safari)", "console.amazonaws.com": "AWS Console",
        "Boto3/1.28 python/3.11": "Python (boto3)", "python-requests/2": "Python (requests)",
        # substring rules over-match by design: "google" contains "go", "javascript" contains "java"
        "Googlebot": "Go Application", "some javascript": "Java Application", "curl/8.0": "cURL",
        "okhttp android": "Mobile (Android)", "iPhone": "Mobile (iOS)", "crawler": "Bot/Crawler",
        "aws-internal/3": "AWS Service", "Terraform/1.5": "Other/Unknown",
    }
    items = list(cases.items())
    got = _one(spark, classify_user_agent("u"), "u string", [(k,) for k, _ in items])
    assert got == [v for _, v in items]


def test_coarse_user_agent_rules(spark):
    cases = {None: "Unknown", "-": "Other", "aws-cli/2.1": "AWS CLI/SDK", "Mozilla/5.0 Safari/605": "Browser",
             "Dalvik Android": "Mobile", "AmazonS3/1": "Cloud Service", "curl/8.0": "Tool",
             "Boto3 python": "Application", "Ruby": "Other"}
    items = list(cases.items())
    assert _one(spark, classify_user_agent_coarse("u"), "u string", [(k,) for k, _ in items]) == [v for _, v in items]


def test_split_requester_forms(spark):
    rows = [(None,), ("-",), ("arn:aws:iam::123456789012:user/acces.admin",),
            ("arn:aws:sts::123456789012:assumed-role/admin/s1",), ("198.51.100.7",),
            ("2001:0db8:0000:0000:0000:ff00:0042:8329",), ("svc:cloudtrail.amazonaws.com",), ("5043e0a2f5c9",)]
    got = [tuple(r) for r in _one(spark, split_requester("r"), "r string", rows)]
    assert got == [("Unknown", "Unknown"), ("Unknown", "Unknown"), ("iam:user/acces.admin", "N/A"),
                   ("sts:assumed-role/admin/s1", "N/A"), ("N/A", "198.51.100.7"),
                   ("N/A", "2001:0db8:0000:0000:0000:ff00:0042:8329"), ("svc:cloudtrail.amazonaws.com", "N/A"),
                   ("5043e0a2f5c9", "N/A")]


def test_tactic_policies(spark):
    ct = {r.name: r.tactic for r in tactic_lookup(spark, "cloudtrail").collect()}
    assert ct["AuthorizeSecurityGroupIngress"] == "Persistence"
    assert ct["GetPasswordData"] == "Credential Access"
    assert ct["DisableKey"] == "Defense Evasion"
    s3 = {r.name: r.tactic for r in tactic_lookup(spark, "s3_access_log").collect()}
    assert s3["REST.HEAD.BUCKET"] == "Discovery" and s3["REST.OPTIONS.PREFLIGHT"] == "Discovery"
    assert "Reconnaissance" not in set(s3.values())
    both = tactic_lookup(spark, "cloudtrail", policy="all").filter(F.col("name") == "DisableKey").count()
    assert both == 2
    # a user-supplied lookup DataFrame resolves the same way
    custom = spark.createDataFrame([("A", "x", 0), ("B", "x", 1)], "tactic string, name string, position long")
    assert tactic_lookup(spark, "s3_access_log", config=custom).first().tactic == "B"
    assert tactic_lookup(spark, "cloudtrail", config=custom).first().tactic == "A"


def test_protocol_names_and_hours(spark):
    assert _one(spark, protocol_name("p"), "p long", [(6,), (17,), (58,), (None,)]) == ["TCP", "UDP", "58", None]
    assert _one(spark, duration_hours("s"), "s long", [(3600,), (5418,), (18,), (54,)]) == [1.0, 1.5, 0.0, 0.02]


def test_user_lookups_leave_the_join_to_the_planner(spark):
    from logsift.operators.enrich import port_service_lookup, tactic_lookup
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(tactic_lookup(spark)) and hinted(port_service_lookup(spark))
    assert not hinted(tactic_lookup(spark, config={"cloudtrail": {"A": ["x"]}})) and not hinted(port_service_lookup(spark, {22: "ssh"}))


def test_cluster_settings_fill_only_unset_keys():
    from logsift.session import CLUSTER_CONF, DEFAULT_CONF, session_settings
    assert session_settings("local[4]") == DEFAULT_CONF
    on_yarn = session_settings("yarn")
    assert on_yarn["spark.sql.shuffle.partitions"] == CLUSTER_CONF["spark.sql.shuffle.partitions"]
    assert on_yarn["spark.decommission.enabled"] == "true"
    submitted = {"spark.master": "k8s://api:443", "spark.sql.shuffle.partitions": "12000"}
    from_submit = session_settings(None, submitted=submitted)
    assert "spark.sql.shuffle.partitions" not in from_submit          # the submitted value stays
    assert from_submit["spark.task.maxFailures"] == "8"
    assert session_settings("yarn", shuffle_partitions=64)["spark.sql.shuffle.partitions"] == "64"
    assert session_settings("yarn", cluster=False) == DEFAULT_CONF


def test_checkpoint_dir_needs_shared_folder_on_cluster():
    import pytest

    from logsift.session import checkpoint_dir

    class Ctx:
        def __init__(self, master, current=None):
            self.master, self.current = master, current

        def getCheckpointDir(self):
            return self.current

        def setCheckpointDir(self, path):
            self.current = path

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, master, conf):
            self.sparkContext, self.conf = Ctx(master), Conf(conf)

    with pytest.raises(ValueError):
        checkpoint_dir(Session("yarn", {}))
    shared = Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert checkpoint_dir(shared) == "hdfs:///shared/ckpt"
    assert shared.sparkContext.getCheckpointDir() == "hdfs:///shared/ckpt"   # registered, not replaced
