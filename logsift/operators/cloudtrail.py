"""CloudTrail analyses over a parsed ``cloudtrail`` table.

Input columns used: ``event_time, event_time_local, aws_region, event_name,
source_ip_address, user_agent, error_code, error_message, request_elements``
and the identity projections ``user_name, user_arn, account_id`` (added by
the parser; :func:`ensure_identity` adds them when only ``user_identity``
exists).  Every function returns a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups
from ..functions.classify import class_counts, classify_user_agent, failure_category_match
from ..functions.common import fmt_ts, last_days, night_rows, order_desc, top_n, with_pct
from ..schemas import IDENTITY_COLUMNS
from .enrich import tactic_lookup, tag_tactics

LOGIN_SUCCESS, LOGIN_FAILED = "Success", "Failed"


def ensure_identity(df: DataFrame) -> DataFrame:
    """Add the identity projection columns when the frame only has the ``user_identity`` map."""
    missing = {name: F.try_element_at("user_identity", F.lit(key))
               for name, key in IDENTITY_COLUMNS if name not in df.columns}
    return df.withColumns(missing) if missing else df


class Counts:
    """Event counts by several dimensions from one pass: ``table`` is (dimension, value, n), NULL values kept.

    The frequency analyses take it in place of the events.
    """

    DIMENSIONS = {"event_name": lambda: F.col("event_name"), "aws_region": lambda: F.col("aws_region"),
                  "ua": lambda: classify_user_agent("user_agent")}

    def __init__(self, table: DataFrame):
        self.table = table
        self.sparkSession = table.sparkSession

    def of(self, dimension: str) -> DataFrame:
        return self.table.filter(F.col("dimension") == dimension)


def dimension_counts(df: DataFrame) -> DataFrame:
    """One scan and one partially aggregated shuffle for every dimension of :class:`Counts`."""
    pairs = [F.struct(F.lit(name).alias("dimension"), value().alias("value")) for name, value in Counts.DIMENSIONS.items()]
    return df.select(F.explode(F.array(*pairs)).alias("d")).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))


def _frequency(df: DataFrame, key: str, out_key: str, count_name: str, pct_name: str,
               total: Column | None = None) -> DataFrame:
    """value_counts(key) with a percentage of ``total`` (default: all rows, NULL keys included).

    The NULL-key group is aggregated too so that the denominator comes from the
    same shuffle; it is removed afterwards.
    """
    if isinstance(df, Counts):
        agg = df.of(key).select(F.col("value").alias(out_key), F.col("n").alias(count_name))
    else:
        agg = df.groupBy(F.col(key).alias(out_key)).agg(F.count(F.lit(1)).alias(count_name))
    agg = with_pct(agg, count_name, pct_name, total)
    # Drop the NULL-key group with a predicate that also reads the count: a
    # predicate on the key alone would be pushed below the aggregation, making
    # it differ from the aggregate the total is computed from, and the input
    # would be scanned and shuffled twice instead of once (exchange reuse).
    keep = F.when(F.col(out_key).isNull(), F.lit(0)).otherwise(F.col(count_name)) > 0
    return top_n(agg.filter(keep), count_name, None, [out_key])


# CT-1 -----------------------------------------------------------------------

def ct_top_ips(df: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """Most active source IPs with first/last access time (UTC and region-local)."""
    agg = (df.filter(F.col("source_ip_address").isNotNull())
           .groupBy(F.col("source_ip_address").alias("ip"))
           .agg(F.count(F.lit(1)).alias("access_count"),
                F.min("event_time").alias("fu"), F.min("event_time_local").alias("fl"),
                F.max("event_time").alias("lu"), F.max("event_time_local").alias("ll")))
    return rank_ips(agg, top_n_rows)


def rank_ips(agg: DataFrame, top_n_rows: int | None = 20) -> DataFrame:
    """``(ip, access_count, fu, fl, lu, ll)`` -> the table of :func:`ct_top_ips`."""
    ranked = top_n(agg, "access_count", top_n_rows, ["ip"])
    return ranked.select("ip", fmt_ts("fu").alias("first_access_utc"), fmt_ts("fl").alias("first_access_local"),
                         fmt_ts("lu").alias("last_access_utc"), fmt_ts("ll").alias("last_access_local"),
                         "access_count")


# CT-2 / CT-3 ------------------------------------------------------------------

def ct_night_ips(df: DataFrame, start_hour: int = 22, end_hour: int = 6, inclusive_end: bool = False) -> DataFrame:
    """Events per source IP at night (region-local hour), most active first."""
    night = df.filter(night_rows(df, "event_time_local", start_hour, end_hour, inclusive_end)
                      & F.col("source_ip_address").isNotNull())
    agg = night.groupBy(F.col("source_ip_address").alias("ip")).agg(F.count(F.lit(1)).alias("access_count"))
    return top_n(agg, "access_count", None, ["ip"])


def ct_night_events(df: DataFrame, start_hour: int = 22, end_hour: int = 6, inclusive_end: bool = True) -> DataFrame:
    """Event names at night (region-local hour, 06:xx included) with % of night events."""
    night = df.filter(night_rows(df, "event_time_local", start_hour, end_hour, inclusive_end))
    return _frequency(night, "event_name", "event_name", "nightshift_event_count", "event_pct")


# CT-4 / CT-5 / CT-8 -------------------------------------------------------------

def ct_event_names(df: DataFrame | Counts) -> DataFrame:
    """Event-name frequency and % of all events."""
    return _frequency(df, "event_name", "event_name", "event_count", "event_pct")


def ct_user_agents(df: DataFrame | Counts) -> DataFrame:
    """Detailed user-agent class frequency and % of all events."""
    if not isinstance(df, Counts):
        counted = class_counts(df, "user_agent", classify_user_agent, "value", "n")
        df = Counts(counted.select(F.lit("ua").alias("dimension"), "value", "n"))
    return _frequency(df, "ua", "user_agent_type", "usage_count", "usage_pct")


def ct_regions(df: DataFrame | Counts) -> DataFrame:
    """Region frequency and % of all events (events without a region count in the total)."""
    return _frequency(df, "aws_region", "region", "event_count", "event_pct")


# CT-6 / CT-7 ------------------------------------------------------------------

_FAILURE_TEXT = "__failure_text"


def _with_failure_text(df: DataFrame) -> DataFrame:
    """The text the failure keywords are matched against, as a column of its own:
    the category generator refers to it once per category, and inside a
    generator each reference would rebuild it."""
    return df.withColumn(_FAILURE_TEXT, F.concat_ws("\u0001", F.col("error_code"), F.col("error_message"),
                                                    F.col("event_name")))


def _failure_categories(names: dict[str, str] | None = None) -> Column:
    """array of matching failure categories per event (an event may be in several);
    reads the column added by :func:`_with_failure_text`."""
    text = F.col(_FAILURE_TEXT)
    labels = [F.when(failure_category_match(text, kws), F.lit((names or {}).get(cat, cat)))
              for cat, kws in lookups.FAILURE_KEYWORDS.items()]
    return F.array_compact(F.array(*labels))


def failed_auth_events(df: DataFrame) -> DataFrame:
    """Failure events, one row per (event, matching category), ``Failure_*`` columns first."""
    df = ensure_identity(df)
    tagged = _with_failure_text(df).withColumn(
        "category", F.explode(_failure_categories(lookups.FAILURE_EVENT_CATEGORY_NAMES)))
    front = [
        F.col("category"),
        fmt_ts("event_time").alias("failure_time"), F.col("source_ip_address").alias("failure_ip"),
        F.col("user_name").alias("failure_user"), F.col("account_id").alias("failure_account"),
        F.col("error_code").alias("failure_type"), F.col("error_message").alias("failure_message"),
        F.col("event_name"),
    ]
    rest = [c for c in df.columns if c != "event_name"]
    return tagged.select(*front, *rest)


def _user_value(user_field: str | list[str]) -> Column:
    """One column, or the first non-NULL of several (``["user_name", "principal_id", "user_type"]``)."""
    return F.col(user_field) if isinstance(user_field, str) else F.coalesce(*user_field)


def _failure_value_counts(df: DataFrame, user_field: str | list[str]) -> DataFrame:
    """``(category, dimension, value, count)`` over failure events, NULL values kept.

    Every failure event contributes to both dimensions (``IPs`` and
    ``Users``), so the NULL-value groups also record which categories occur.
    One scan, one partially aggregated shuffle.
    """
    hits = _with_failure_text(df).select(F.explode(_failure_categories()).alias("category"),
                     F.col("source_ip_address").alias("ip"), _user_value(user_field).alias("user"))
    pairs = hits.select("category", F.explode(F.array(
        F.struct(F.lit("IPs").alias("dimension"), F.col("ip").alias("value")),
        F.struct(F.lit("Users").alias("dimension"), F.col("user").alias("value")))).alias("d"))
    return (pairs.select("category", "d.dimension", "d.value")
            .groupBy("category", "dimension", "value").agg(F.count(F.lit(1)).alias("count")))


def failed_auth_details(df: DataFrame, user_field: str | list[str] = "user_name") -> DataFrame:
    """``(category, dimension, value, count)`` for every failure category, dimension
    ``IPs``/``Users`` and distinct value."""
    df = ensure_identity(df)
    return _failure_value_counts(df, user_field).filter(F.col("value").isNotNull())


def ct_failed_auth(df: DataFrame, user_field: str | list[str] = "user_name") -> DataFrame:
    """Every distinct IP and user of every failure category with its exact count:
    ``category`` (``<category> - IPs`` / ``<category> - Users``), ``value``, ``count`` and
    ``distinct_values`` of the category.  A category whose events name no value has
    one row with NULL, 0 and 0.

    One row per value, so nothing is cut and no category is gathered in one
    row; both branches read the same aggregate of the input (one pass).
    """
    return failed_auth_table(_failure_value_counts(ensure_identity(df), user_field))


def failed_auth_table(counted: DataFrame) -> DataFrame:
    """``(category, dimension, value, count)`` with NULL values -> the table of :func:`ct_failed_auth`."""
    # `events > 0` holds by construction; it keeps the count column in use, otherwise
    # column pruning would drop it from this branch's aggregate and the two branches
    # would each scan the input
    summary = (counted.groupBy("category", "dimension")
               .agg(F.count("value").alias("distinct_values"), F.sum("count").alias("events"))
               .filter(F.col("events") > 0))
    # two rows per failure category of the fixed keyword table
    out = counted.join(F.broadcast(summary), ["category", "dimension"])
    out = out.filter(F.col("value").isNotNull() | (F.col("distinct_values") == 0))
    return out.select(F.concat_ws(" - ", "category", "dimension").alias("category"), "value",
                      F.when(F.col("value").isNull(), 0).otherwise(F.col("count")).cast("long").alias("count"), "distinct_values")


def failed_auth_preview(df: DataFrame, k: int = 20, user_field: str | list[str] = "user_name") -> DataFrame:
    """Display text per category: ``value (count)`` of the ``k`` most frequent values, and how many there are.

    A preview only; the complete table is :func:`ct_failed_auth`.  Values are
    ranked by a two-level top-k: within each of many salts of the value first,
    then among the ``k`` of every salt, whatever ``k`` is.
    """
    full = ct_failed_auth(df, user_field)
    order = [F.col("count").desc(), F.col("value").asc_nulls_last()]
    salted = full.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(1024)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("category", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(*order))).filter(F.col("rank") <= k)
    label = F.when(F.col("value").isNull(), "N/A").otherwise(F.format_string("%s (%d)", F.col("value"), F.col("count")))
    return top.groupBy("category").agg(
        F.first("distinct_values").alias("distinct_values"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))), lambda x: x["label"]), "; ").alias("preview"))


# CT-9 / CT-10 -----------------------------------------------------------------

def ct_console_login(df: DataFrame, days: int | None = None, as_of: str | None = None,
                     status_from: str = "error_code") -> DataFrame:
    """Console logins (one row per event), newest first.

    ``Failed`` when ``error_code`` is set (``status_from='response'`` reads
    ``responseElements.ConsoleLogin`` instead).  Logins without a user name or
    with user ``Unknown`` are skipped.  ``days`` keeps the last N days before
    ``as_of`` (default now, UTC).
    """
    df = ensure_identity(df)
    if status_from == "response":
        resp = F.try_variant_get(F.try_parse_json("response_elements"), "$.ConsoleLogin", "string")
        failed = F.coalesce(resp != "Success", F.lit(False))
    else:
        failed = F.col("error_code").isNotNull() & (F.col("error_code") != "")
    logins = df.filter((F.col("event_name") == "ConsoleLogin")
                       & F.col("user_name").isNotNull() & (F.col("user_name") != "") & (F.col("user_name") != "Unknown")
                       & last_days("event_time", days, as_of))
    out = logins.select(
        F.col("user_name").alias("user"), "event_time",
        fmt_ts("event_time").alias("event_time_utc"), fmt_ts("event_time_local").alias("event_time_local"),
        F.col("source_ip_address").alias("source_ip"), F.col("aws_region").alias("region"),
        F.when(failed, LOGIN_FAILED).otherwise(LOGIN_SUCCESS).alias("login_status"), "user_agent")
    return out.orderBy(F.col("event_time").desc_nulls_last(), F.col("user")).drop("event_time")


def ct_create_user(df: DataFrame) -> DataFrame:
    """CreateUser events: created user (``requestParameters.userName``, else ``Unknown``),
    creator ARN, times, IP and region; newest first."""
    df = ensure_identity(df)
    created = F.from_json("request_elements", "userName string")["userName"]      # a repeated key takes its last value
    out = df.filter(F.col("event_name") == "CreateUser").select(
        F.coalesce(created, F.lit("Unknown")).alias("created_user"), F.col("user_arn").alias("created_by_arn"),
        "event_time", fmt_ts("event_time").alias("event_time_utc"),
        fmt_ts("event_time_local").alias("event_time_local"),
        F.col("source_ip_address").alias("source_ip"), F.col("aws_region").alias("region"))
    return out.orderBy(F.col("event_time").desc_nulls_last(), F.col("created_user")).drop("event_time")


def events_of(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The events whose ``column`` is one of a few values, for point lookups over a landed table: equality
    reaches the files' Bloom filters, so row groups without the values aren't read."""
    return df.where(F.col(column).isin(list(values)))


# CT-11 / CT-12 ----------------------------------------------------------------

def _lookup(df: DataFrame | Counts, lookup: DataFrame | None, policy: str | None) -> DataFrame:
    return lookup if lookup is not None else tactic_lookup(df.sparkSession, "cloudtrail", policy=policy)


def ct_tactics(df: DataFrame | Counts, lookup: DataFrame | None = None, policy: str | None = None) -> DataFrame:
    """(tactic, event name) hit counts with % of all events; tactic A-Z, hits desc.

    Events are counted per name first (partial aggregation, one shuffle); the
    tactic lookup is then joined to that small aggregate, and the total comes
    from the same aggregate, so the input is scanned once.
    """
    # non-NULL key: otherwise the join's inferred "key IS NOT NULL" would be pushed
    # below the aggregation and the total could no longer reuse its shuffle
    if isinstance(df, Counts):
        by_name = df.of("event_name").select(F.coalesce("value", F.lit("")).alias("event_name"), F.col("n").alias("hit_count"))
    else:
        by_name = df.groupBy(F.coalesce("event_name", F.lit("")).alias("event_name")).agg(F.count(F.lit(1)).alias("hit_count"))
    total = by_name.select(F.sum("hit_count")).scalar()
    hits = tag_tactics(by_name, _lookup(df, lookup, policy), "event_name", how="inner")
    out = with_pct(hits.select("tactic", "event_name", "hit_count"), "hit_count", "event_pct", total)
    return out.orderBy(F.col("tactic").asc(), *order_desc("hit_count", ["event_name"]))


def ct_tactic_events(df: DataFrame, lookup: DataFrame | None = None, policy: str | None = None,
                     sort: bool = True) -> DataFrame:
    """Every event with a mapped tactic, tactic first; ordered by tactic then time.

    ``sort=False`` skips the global sort (write partitioned by tactic instead).
    """
    tagged = tag_tactics(df, _lookup(df, lookup, policy), "event_name", how="inner")
    out = tagged.select("tactic", *df.columns)
    if sort:
        out = out.orderBy(F.col("tactic").asc(), F.col("event_time").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    return out
