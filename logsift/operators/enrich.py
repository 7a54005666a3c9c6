"""Enrichment: region-local time, tactic tagging, protocol and service names.

Lookups with a fixed, tiny domain (18 regions, 6 protocols) are inline map
literals: a projection, no join at all.  Lookups users may replace (tactics,
remote-access ports) are DataFrames.  The packaged ones, a few hundred rows by
construction, carry a broadcast hint; for any other the planner chooses from
statistics (and again at run time with AQE).
"""

from __future__ import annotations

import itertools
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lookups
from ..functions.common import col


def _map_literal(mapping: dict) -> Column:
    return F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def region_offset_minutes(region: str | Column, offsets: dict | None = None) -> Column:
    """Region -> UTC offset in minutes; unknown regions give 0."""
    mapping = lookups.region_offset_minutes() if offsets is None else offsets
    return F.coalesce(F.try_element_at(_map_literal(mapping), col(region)), F.lit(0))


def local_time(event_time: str | Column, region: str | Column, offsets: dict | None = None) -> Column:
    """Region-local wall-clock time (seconds truncated); NULL when time or region is missing."""
    t = col(event_time)
    r = col(region)
    shifted = F.timestamp_add("MINUTE", region_offset_minutes(r, offsets), F.date_trunc("second", t).cast("timestamp_ntz"))
    return F.when(t.isNotNull() & r.isNotNull() & (r != ""), shifted)


def add_local_time(df: DataFrame, time_col: str = "event_time", region_col: str = "aws_region",
                   out_col: str = "event_time_local", offsets: dict | None = None) -> DataFrame:
    return df.withColumn(out_col, local_time(time_col, region_col, offsets))


def protocol_name(protocol: str | Column) -> Column:
    """Protocol number -> name (``6`` -> ``TCP``); unmapped numbers are shown as text."""
    p = col(protocol)
    return F.coalesce(F.try_element_at(_map_literal(lookups.PROTOCOL_NAMES), p.cast("int")), p.cast("string"))


def port_service_lookup(spark: SparkSession, ports: dict | None = None) -> DataFrame:
    """``(port bigint, service string)`` for the remote-access ports."""
    mapping = lookups.REMOTE_ACCESS_PORTS if ports is None else ports
    rows = [(int(k), str(v)) for k, v in mapping.items()]
    lookup = spark.createDataFrame(rows, "port bigint, service string")
    return F.broadcast(lookup) if ports is None else lookup


def read_tactic_file(spark: SparkSession, path: str) -> dict:
    """:func:`~logsift.lookups.load_tactic_config` for a path on any storage that Spark reads."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return {}
    return lookups.checked_tactics(json.loads(text[0] if text else ""), path)


def tactic_lookup(spark: SparkSession, log_type: str = "cloudtrail", config: dict | DataFrame | None = None,
                  policy: str | None = None) -> DataFrame:
    """``(name, tactic)`` lookup for one log type.

    ``config`` is a ``{log_type: {tactic: [names]}}`` dict (default: the packaged
    mapping) or a DataFrame with columns ``tactic, name, position``.
    ``policy`` resolves names listed under several tactics: ``first`` (lowest
    position, CloudTrail default), ``last`` (S3 default) or ``all`` (one row
    per tactic).
    """
    policy = policy or lookups.TACTIC_POLICY.get(log_type, "first")
    if policy not in ("first", "last", "all"):
        raise ValueError(f"unknown tactic policy {policy!r}")
    if isinstance(config, DataFrame):
        rows = config.select("tactic", "name", "position")
        if policy == "all":
            return rows.select("name", "tactic").dropDuplicates()
        pick = F.min_by if policy == "first" else F.max_by
        return rows.groupBy("name").agg(pick("tactic", "position").alias("tactic"))
    flat = lookups.tactic_rows(config, log_type)
    if policy == "all":
        pairs = sorted({(name, tactic) for tactic, name, _ in flat})
    else:
        chosen: dict[str, str] = {}
        for tactic, name, _ in flat:
            if policy == "last" or name not in chosen:
                chosen[name] = tactic
        pairs = sorted(chosen.items())
    lookup = spark.createDataFrame(pairs, "name string, tactic string")
    return F.broadcast(lookup) if config is None else lookup


def tag_tactics(df: DataFrame, lookup: DataFrame, key_col: str, out_col: str = "tactic",
                how: str = "left") -> DataFrame:
    """Attach the tactic of ``key_col`` (broadcast hash join on the small lookup).

    ``how='inner'`` keeps only mapped rows (the tagged-event listings).
    """
    lk = lookup.select(F.col("name").alias("__tactic_key"), F.col("tactic").alias(out_col))
    joined = df.join(lk, df[key_col] == F.col("__tactic_key"), how)
    return joined.drop("__tactic_key")
