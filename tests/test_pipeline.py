"""Whole-flow runner: directories in, parsed + analysis tables and a summary out."""

import json
import os

import pytest

from logsift.plans.pipeline import run_pipeline

from test_sources import S3_LINES, VPC_LINES, _event, _write


def test_run_pipeline(spark, tmp_dir):
    _write(f"{tmp_dir}/in/ct/a.json", json.dumps({"Records": [_event(i) for i in range(5)]}))
    _write(f"{tmp_dir}/in/vpc/a.log", VPC_LINES)
    _write(f"{tmp_dir}/in/s3/a.log", S3_LINES)
    out = f"{tmp_dir}/out"
    summary = run_pipeline(spark, out, cloudtrail=f"{tmp_dir}/in/ct", vpc=f"{tmp_dir}/in/vpc",
                           s3=f"{tmp_dir}/in/missing", as_of="2025-10-10")
    got = {r.log_type: (r.status, r.parsed_events) for r in summary.collect()}
    assert got == {"cloudtrail": ("ok", 5), "vpc": ("ok", 3), "s3": ("error", 0)}
    assert {r.log_type: r.rejected for r in summary.collect()} == {"cloudtrail": 0, "vpc": 1, "s3": None}
    tables = os.listdir(f"{out}/analysis/cloudtrail")
    assert "ConsoleLogin_Statistics" in tables and "Mitre_ATTACK_Events" in tables
    logins = spark.read.parquet(f"{out}/analysis/cloudtrail/ConsoleLogin_Statistics")
    assert logins.count() == 5
    assert spark.read.parquet(f"{out}/analysis/vpc/Connection_Statistics__Top_20_").count() == 3


def test_tactics_parsed_tables_and_csv(spark, tmp_dir):
    _write(f"{tmp_dir}/in/ct/a.json", json.dumps({"Records": [_event(i) for i in range(5)]}))
    _write(f"{tmp_dir}/tactics.json", json.dumps({"cloudtrail": {"Mine": ["ConsoleLogin"]}}))
    first = run_pipeline(spark, f"{tmp_dir}/a", cloudtrail=f"{tmp_dir}/in/ct", tactics_file=f"{tmp_dir}/tactics.json", land_csv=True)
    assert first.where("log_type = 'cloudtrail'").first().status == "ok"
    tactics = spark.read.parquet(f"{tmp_dir}/a/analysis/cloudtrail/Mitre_ATTACK_Tactics")
    assert [(r.tactic, r.event_name, r.hit_count) for r in tactics.collect()] == [("Mine", "ConsoleLogin", 5)]
    totals = spark.read.parquet(f"{tmp_dir}/a/analysis/cloudtrail/Report_Tactic_Totals")
    assert [(r.tactic, r.total_hits) for r in totals.collect()] == [("Mine", 5)]
    os.rename(f"{tmp_dir}/a/parsed_csv/cloudtrail", f"{tmp_dir}/landed.csv")
    for path in (f"{tmp_dir}/a/parsed/cloudtrail", f"{tmp_dir}/landed.csv"):
        again = run_pipeline(spark, f"{tmp_dir}/b", parsed={"cloudtrail": path}, tactics_file=f"{tmp_dir}/tactics.json")
        assert again.where("log_type = 'cloudtrail'").first()[:3] == ("cloudtrail", "ok", 5)
        for table in ("Mitre_ATTACK_Tactics", "Failed_Auth_Statistics", "Failed_Auth_Events", "ConsoleLogin_Statistics"):
            a, b = (spark.read.parquet(f"{tmp_dir}/{x}/analysis/cloudtrail/{table}").count() for x in "ab")
            assert a == b, table
    _write(f"{tmp_dir}/bad.json", "[1, 2]")
    with pytest.raises(ValueError):
        run_pipeline(spark, f"{tmp_dir}/c", cloudtrail=f"{tmp_dir}/in/ct", tactics_file=f"{tmp_dir}/bad.json")


def test_command_line_exit_status(tmp_dir):
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    _write(f"{tmp_dir}/in/vpc/a.log", VPC_LINES)
    base = [sys.executable, "-m", "logsift", "--master", "local[2]", "--format", "csv"]
    ok = subprocess.run(base + ["--output", f"{tmp_dir}/out1", "--vpc", f"{tmp_dir}/in/vpc"],
                        cwd=root, capture_output=True, text=True, timeout=300)
    assert ok.returncode == 0, ok.stderr[-2000:]
    assert "successful log types: 1" in ok.stdout
    assert os.listdir(f"{tmp_dir}/out1/analysis/vpc")
    # the output folder is a file: nothing can be written under it -> exit status 1
    _write(f"{tmp_dir}/out2", "not a folder")
    bad = subprocess.run(base + ["--output", f"{tmp_dir}/out2", "--vpc", f"{tmp_dir}/in/vpc"],
                         cwd=root, capture_output=True, text=True, timeout=300)
    assert bad.returncode == 1 and "error" in bad.stdout
