"""Command line: ``python -m logsift --output OUT [--cloudtrail DIR] [--vpc DIR] [--s3 DIR]`` (see ``--help``)."""

from __future__ import annotations

import argparse
import sys

from .plans.pipeline import run_pipeline
from .session import build_session


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="logsift", description="Parse and analyse cloud audit-log directories.")
    ap.add_argument("--output", required=True, help="output folder (parsed tables and analysis tables)")
    ap.add_argument("--cloudtrail", help="CloudTrail log directory (.json, .jsonl, .json.gz)")
    ap.add_argument("--vpc", help="VPC Flow Log directory (.log, .txt, .gz or dated names)")
    ap.add_argument("--s3", help="S3 server-access-log directory")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"], help="format of analysis tables")
    ap.add_argument("--as-of", help="reference time for 'last N days' tables (default: now, UTC)")
    ap.add_argument("--master", help="Spark master (default: from the environment)")
    ap.add_argument("--no-rebalance-parsed", action="store_true",
                    help="land parsed records without the shuffle by event date (inputs laid out by date)")
    ap.add_argument("--parsed", action="append", default=[], metavar="TYPE=PATH",
                    help="analyse a table parsed before (Parquet folder, or .csv in the original layout); TYPE is cloudtrail, vpc or s3")
    ap.add_argument("--tactics", help="JSON file {log type: {tactic: [names]}} in place of the packaged tactics")
    ap.add_argument("--land-csv", action="store_true", help="also write the parsed tables as CSV in the original layout")
    ap.add_argument("--ignore-corrupt", action="store_true", help="keep what can be read of damaged files instead of failing")
    ap.add_argument("--top", type=int, default=20, help="rows of the top-N tables")
    args = ap.parse_args(argv)
    parsed = dict(p.split("=", 1) if "=" in p else ap.error(f"--parsed {p}: expected TYPE=PATH") for p in args.parsed)
    if set(parsed) - {"cloudtrail", "vpc", "s3"}:
        ap.error("--parsed: the log type is cloudtrail, vpc or s3")
    if not (args.cloudtrail or args.vpc or args.s3 or parsed):
        ap.error("give at least one of --cloudtrail, --vpc, --s3, --parsed")
    spark = build_session(args.master)
    summary = run_pipeline(spark, args.output, args.cloudtrail, args.vpc, args.s3, fmt=args.format, as_of=args.as_of,
                           top_n=args.top, rebalance_parsed=not args.no_rebalance_parsed, parsed=parsed,
                           tactics_file=args.tactics, land_csv=args.land_csv, ignore_corrupt=args.ignore_corrupt)
    summary.show(truncate=False)
    statuses = [r.status for r in summary.select("status").collect()]   # one row per log type
    print(f"successful log types: {statuses.count('ok')}")
    # non-zero exit when a given log type failed, so a scheduler sees it
    return 1 if "error" in statuses else 0


if __name__ == "__main__":
    sys.exit(main())
