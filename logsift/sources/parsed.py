"""Load an already-parsed table: our Parquet, or a CSV in the original layout.

CSV files written by the original tool use camelCase / legacy names
(``eventTime``, ``userIdentity.userName``, ``window_start_(UTC+0)`` or
``window_start`` with a `` (UTC+0)`` suffix, ``request_datetime_(UTC+0)`` or
the bracketed ``request_datetime``).  They are read as text (no inference) and
coerced to the canonical schema with ``try_*`` casts, so bad values become
NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import blank_to_null, parse_iso_utc, parse_naive
from ..schemas import IDENTITY_PREFIX, SCHEMAS, csv_names
from .s3 import s3_time


def _conform(df: DataFrame, log_type: str) -> DataFrame:
    """Select the canonical columns in order, casting; absent columns become NULL."""
    schema = SCHEMAS[log_type]
    cols = []
    for field in schema.fields:
        if field.name in df.columns:
            c = F.col(field.name)
            cols.append((c if df.schema[field.name].dataType == field.dataType else c.try_cast(field.dataType))
                        .alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols, *extra)


def _from_csv(df: DataFrame, log_type: str) -> DataFrame:
    names = csv_names(log_type)
    df = df.select([blank_to_null(F.col(f"`{c}`")).alias(names.get(c, c)) for c in df.columns])
    if log_type == "cloudtrail":
        ident = [c for c in df.columns if c.startswith(IDENTITY_PREFIX)]
        if ident:
            m = F.map_filter(F.create_map(*[x for c in ident for x in (F.lit(c[len(IDENTITY_PREFIX):]), F.col(f"`{c}`"))]),
                             lambda k, v: v.isNotNull())
            if "userIdentity" in df.columns:              # the keys that have no column of their own
                others = F.from_json("userIdentity", "map<string,string>")
                m = F.map_concat(m, F.coalesce(others, F.create_map().cast("map<string,string>")))
            df = df.withColumn("user_identity", F.when(F.size(m) > 0, m)).drop(*ident, "userIdentity")
        coerce = {
            "event_time": parse_iso_utc("event_time"),
            "event_time_local": parse_naive(F.replace(F.col("event_time_local"), F.lit("T"), F.lit(" "))),
            "read_only": F.lower("read_only").try_cast("boolean"),
            "management_event": F.lower("management_event").try_cast("boolean"),
        }
        df = df.withColumns({k: v for k, v in coerce.items() if k in df.columns})
    elif log_type == "vpc":
        for c in ("window_start", "window_end"):
            if c in df.columns:
                df = df.withColumn(c, parse_naive(F.replace(F.col(c), F.lit(" (UTC+0)"), F.lit(""))))
    elif log_type == "s3":
        if "request_datetime" in df.columns:
            rd = F.col("request_datetime")
            df = df.withColumn("request_datetime",
                               F.when(rd.startswith("["), s3_time(rd)).otherwise(parse_naive(rd)))
        elif "original_timestamp" in df.columns:
            df = df.withColumn("request_datetime", s3_time("original_timestamp"))
    return _conform(df, log_type)


def load_parsed(spark: SparkSession, path: str, log_type: str, fmt: str = "parquet") -> DataFrame:
    """Read a parsed ``cloudtrail`` / ``vpc`` / ``s3`` table in canonical form."""
    if fmt == "parquet":
        try:
            df = spark.read.parquet(path)
        except AnalysisException as exc:
            if "UNABLE_TO_INFER_SCHEMA" not in str(exc) and "PATH_NOT_FOUND" not in str(exc):
                raise
            df = spark.createDataFrame([], SCHEMAS[log_type])   # nothing was landed: empty table
        df = _conform(df, log_type)
    elif fmt == "csv":
        df = _from_csv(spark.read.option("header", "true").option("inferSchema", "false")
                       .option("escape", '"').csv(path), log_type)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    if log_type == "cloudtrail":
        from .cloudtrail import with_identity_columns

        df = with_identity_columns(df)
    return df
