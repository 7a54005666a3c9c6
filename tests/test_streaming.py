"""Incremental ingestion gives the same rows as the batch sources, once per file."""

import json
import os

from logsift.sources.cloudtrail import read_cloudtrail
from logsift.sources.s3 import read_s3_access
from logsift.sources.vpc import read_vpc_flow
from logsift.streaming.ingest import ingest

from test_sources import S3_LINES, VPC_LINES, _event, _write


def _run(spark, src, log_type, out, ckpt):
    q = ingest(spark, src, log_type, out, checkpoint_location=ckpt)
    q.awaitTermination(120)
    return spark.read.parquet(out)


def test_ingest_matches_batch_and_is_incremental(spark, tmp_dir):
    for log_type, reader, name, text in (("vpc", read_vpc_flow, "a.log", VPC_LINES),
                                         ("s3", read_s3_access, "a.log", S3_LINES)):
        src = os.path.join(tmp_dir, f"{log_type}_src")
        out, ckpt = os.path.join(tmp_dir, f"{log_type}_out"), os.path.join(tmp_dir, f"{log_type}_ckpt")
        _write(f"{src}/{name}", text)
        first = _run(spark, src, log_type, out, ckpt)
        batch = reader(spark, src)
        assert first.count() == batch.count() > 0
        _write(f"{src}/more/b.log", text)       # a new delivery
        second = _run(spark, src, log_type, out, ckpt)
        assert second.count() == 2 * batch.count()   # old file not re-read


def test_ingest_cloudtrail(spark, tmp_dir):
    src = os.path.join(tmp_dir, "ct_src")
    _write(f"{src}/a.json", json.dumps({"Records": [_event(1), _event(2)]}))
    _write(f"{src}/b.jsonl", json.dumps(_event(3)) + "\n" + json.dumps(_event(4)))
    out = _run(spark, src, "cloudtrail", os.path.join(tmp_dir, "ct_out"), os.path.join(tmp_dir, "ct_ckpt"))
    assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in read_cloudtrail(spark, src).collect())
