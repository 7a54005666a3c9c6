"""The whole flow for a set of log directories: parse -> land -> analyse -> write -> summary.

For each log type given a path: scan and parse the directory, land the parsed
table as date-partitioned Parquet (lineage is cut there: the analyses read
the written table), run the analysis bundle and write every result table.  A
table that was parsed before (``parsed``) is analysed as it is.  A failure in
one log type is recorded in the summary and does not stop the others.
"""

from __future__ import annotations

import traceback
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lookups
from ..operators.enrich import tactic_lookup
from ..sources.cloudtrail import read_cloudtrail
from ..sources.files import Rejects
from ..sources.parsed import load_parsed
from ..sources.s3 import read_s3_access
from ..sources.vpc import read_vpc_flow
from .bundle import export_ordered, run_analysis, write_bundle, write_parsed

READERS = {"cloudtrail": read_cloudtrail, "vpc": read_vpc_flow, "s3": read_s3_access}
TACTIC_KEYS = {"cloudtrail": "cloudtrail", "s3": "s3_access_log"}
SUMMARY = "log_type string, status string, parsed_events bigint, rejected bigint, message string"


def _parsed_format(path: str) -> str:
    return "csv" if path.rstrip("/").endswith(".csv") else "parquet"


def run_pipeline(spark: SparkSession, output: str, cloudtrail: str | list[str] | None = None,
                 vpc: str | list[str] | None = None, s3: str | list[str] | None = None, fmt: str = "parquet",
                 as_of: str | None = None, top_n: int = 20, rebalance_parsed: bool = True,
                 parsed: Mapping[str, str] | None = None, tactics_file: str | None = None,
                 land_csv: bool = False, ignore_corrupt: bool = False,
                 user_field: str | list[str] = "user_name") -> DataFrame:
    """Process every given log directory; returns the run summary
    ``(log_type, status, parsed_events, rejected, message)``.

    ``rejected`` counts, in the parsing pass, lines and documents that could not
    be read, values that are no records and (S3) lines that only the fallback
    could read.  ``status`` is ``ok``, ``no data`` (nothing found), ``skipped`` or
    ``error``; a path that isn't there is an error.

    ``parsed`` maps log types to tables that were landed before (Parquet, or a
    ``.csv`` path in the original layout), in place of a log directory.
    ``tactics_file`` is a JSON file ``{log_type: {tactic: [names]}}`` that
    replaces the packaged tactics.  ``rebalance_parsed=False`` lands without
    the shuffle by event date (see :func:`write_parsed`).  ``land_csv`` also
    writes the parsed table in the original CSV layout.  ``ignore_corrupt``
    keeps what could be read of damaged files instead of failing.

    Layout under ``output``: ``parsed/<log_type>/event_date=...``,
    ``parsed_csv/<log_type>/`` and ``analysis/<log_type>/<table>/``.
    """
    out = output.rstrip("/")
    config = lookups.load_tactic_config(tactics_file) if tactics_file else None
    rows = []
    for log_type, path in (("cloudtrail", cloudtrail), ("vpc", vpc), ("s3", s3)):
        landed = (parsed or {}).get(log_type)
        if not path and not landed:
            rows.append((log_type, "skipped", 0, None, "no path given"))
            continue
        try:
            rejected = None
            if landed:
                df = load_parsed(spark, landed, log_type, _parsed_format(landed))
            else:
                landed, rejects = f"{out}/parsed/{log_type}", Rejects()
                raw = READERS[log_type](spark, path, rejects=rejects, ignore_corrupt=ignore_corrupt)
                write_parsed(raw, landed, log_type, rebalance=rebalance_parsed)
                rejected = rejects.total()
                df = load_parsed(spark, landed, log_type)
            n = df.count()
            if n == 0:
                rows.append((log_type, "no data", 0, rejected, "no records found"))
                continue
            if land_csv:
                export_ordered(df, log_type, f"{out}/parsed_csv/{log_type}")
            lookup = None
            if config is not None and log_type in TACTIC_KEYS:
                lookup = tactic_lookup(spark, TACTIC_KEYS[log_type], config)
            tables = run_analysis(df, log_type, as_of=as_of, lookup=lookup, top_n=top_n, user_field=user_field)
            write_bundle(tables, f"{out}/analysis", log_type, fmt=fmt, as_of=as_of)
            rows.append((log_type, "ok", n, rejected, f"{len(tables)} tables"))
        except Exception as exc:  # noqa: BLE001 - isolate one log type's failure, as a batch runner
            rows.append((log_type, "error", 0, None, f"{type(exc).__name__}: {exc}"))
            traceback.print_exc()
    return spark.createDataFrame(rows, SUMMARY).withColumn("parsed_events", F.col("parsed_events").cast("long"))
