"""Column helpers shared by every log type.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside whole-stage code generation; none of them uses a Python UDF.
Timestamps are ``TIMESTAMP_NTZ`` holding UTC wall-clock time; the conversions
below never depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
HOUR_COLUMN = "night_hour"      # of a landed table: the hour that its night filters test
_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_WS = " \t\r\n\f\u000b"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """``''`` -> NULL; every other value (``-`` and ``N/A`` included) is kept."""
    return F.nullif(col(c), F.lit(""))


def strip_ws(c: str | Column) -> Column:
    """Strip leading/trailing whitespace (spaces, tabs, CR, LF, FF, VT)."""
    return F.btrim(col(c), F.lit(_WS))


_FIRST_SECOND, _LAST_SECOND = -62135596800, 253402300799    # years 1 to 9999


def epoch_seconds_to_ntz(seconds: str | Column) -> Column:
    """Epoch seconds (bigint) -> UTC wall-clock TIMESTAMP_NTZ; outside the years 1 to 9999 -> NULL."""
    s = col(seconds)
    return F.timestamp_add("SECOND", F.when(s.between(_FIRST_SECOND, _LAST_SECOND), s), F.expr(_EPOCH_NTZ))


def instant_to_ntz(ts: str | Column) -> Column:
    """TIMESTAMP (an instant) -> its UTC wall-clock TIMESTAMP_NTZ, independent of session zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col(ts)), F.expr(_EPOCH_NTZ))


def parse_iso_utc(text: str | Column) -> Column:
    """ISO-8601 text (``2024-01-01T00:00:07Z``, offsets allowed) -> UTC NTZ; invalid -> NULL."""
    return instant_to_ntz(F.try_to_timestamp(col(text)))


_INTEGER_TEXT = r"^[+-]?[0-9]+$"


def to_integer(text: str | Column, type_name: str = "bigint") -> Column:
    """Integer text -> number; ``-``, blanks and other text -> NULL.

    The digit test runs first because a failing ``try_cast`` goes through an
    exception inside the JVM, which costs microseconds per value; log fields
    are ``-`` very often.
    """
    c = col(text)
    return F.when(c.rlike(_INTEGER_TEXT), c.try_cast(type_name))


def parse_naive(text: str | Column) -> Column:
    """Zone-less ``yyyy-MM-dd HH:mm:ss`` text -> TIMESTAMP_NTZ; invalid -> NULL."""
    return col(text).try_cast("timestamp_ntz")


def fmt_ts(ts: str | Column) -> Column:
    """Datetime -> ``yyyy-MM-dd HH:mm:ss`` text; NULL stays NULL."""
    return F.date_format(col(ts), TS_FORMAT)


def utc_now_ntz() -> Column:
    return instant_to_ntz(F.current_timestamp())


def night_window(hour: str | Column, start: int = 22, end: int = 6, inclusive_end: bool = False) -> Column:
    """Night-shift predicate on an hour-of-day column.

    ``hour >= start OR hour < end`` (``<= end`` when ``inclusive_end``).  A NULL
    hour is not night.
    """
    h = col(hour)
    upper = (h <= end) if inclusive_end else (h < end)
    return F.coalesce((h >= start) | upper, F.lit(False))


def night_rows(df: DataFrame, time: str, start: int = 22, end: int = 6, inclusive_end: bool = False) -> Column:
    """:func:`night_window` as a row filter, on the landed hour of ``time`` (``HOUR_COLUMN``) where the table has it.

    A comparison with a stored column reaches the files: those, row groups and pages whose hours can't
    match aren't read.  A NULL hour is not night.
    """
    if HOUR_COLUMN not in df.columns:
        return night_window(F.hour(time), start, end, inclusive_end)
    h = F.col(HOUR_COLUMN)
    return (h >= start) | ((h <= end) if inclusive_end else (h < end))


def pct(n: str | Column, total: str | Column) -> Column:
    """``round(n / total * 100, 2)`` with exact half-even rounding, as a double.

    Integer arithmetic only, on decimals wide enough for any bigint counts:
    ``q, r = divmod(n * 10000, total)``; round ``q`` half to even on ``r``;
    divide by 100.  Gives the same double in Spark and in SQL engines, with no
    float noise.  ``total <= 0`` gives NULL.
    """
    total = F.when(col(total) > 0, col(total)).cast("decimal(20,0)")
    q, r = div_mod(col(n).cast("decimal(20,0)") * F.lit(10000).cast("decimal(5,0)"), total)
    return half_even(q, r, total) / F.lit(100.0)


def div_mod(n: Column, d: Column) -> tuple[Column, Column]:
    """Integral quotient (bigint) and remainder of whole numbers."""
    return F.call_function("div", n, d), n % d


def half_even(q: Column, r: Column, d: Column) -> Column:
    """The quotient ``q`` with remainder ``r`` on division by ``d``, rounded half to even."""
    return q + F.when((r * 2 > d) | ((r * 2 == d) & (q % 2 == 1)), 1).otherwise(0)


def with_pct(agg: DataFrame, count_col: str, out_col: str, total: Column | None = None) -> DataFrame:
    """Add ``out_col`` = pct of ``count_col`` over ``total``.

    ``total`` defaults to the sum of ``count_col`` over the whole aggregate, as
    a scalar subquery: it is computed once (from the already-shuffled partial
    counts) and inlined, so no join, no cross product and no single-partition
    window is needed.  The total is first bound to a column so the percentage
    expression refers to one subquery, not one per use.
    """
    if total is None:
        total = agg.select(F.sum(count_col)).scalar()
    return (agg.withColumn("__total", total)
               .withColumn(out_col, pct(F.col(count_col), F.col("__total")))
               .drop("__total"))


def order_desc(measure: str | Sequence[str], keys: Sequence[str] = (), sums: bool = False) -> list[Column]:
    """Sort spec: measure(s) descending, then keys ascending; NULLs last both ways.

    Tie-breaking on every key column makes top-N results deterministic.  With
    ``sums`` a NULL measure is a sum beyond bigint and comes first.
    """
    measures = [measure] if isinstance(measure, str) else list(measure)
    return ([F.col(m).desc_nulls_first() if sums else F.col(m).desc_nulls_last() for m in measures]
            + [F.col(k).asc_nulls_last() for k in keys])


def top_n(df: DataFrame, measure: str | Sequence[str], n: int | None, keys: Sequence[str],
          sums: bool = False) -> DataFrame:
    """Rank by ``measure`` desc (ties by ``keys`` asc) and keep ``n`` rows.

    Planned as ``TakeOrderedAndProject``: every partition keeps its own best
    ``n`` and only those reach the final merge, so the cost does not grow with
    the number of groups.  ``n=None`` returns the full ordering.
    """
    ordered = df.orderBy(*order_desc(measure, keys, sums))
    return ordered if n is None else ordered.limit(n)


def sum0(c: str | Column) -> Column:
    """Sum skipping NULLs; an all-NULL (or empty) group gives 0.

    A sum beyond bigint is NULL (no job is aborted by it); no other sum is, so
    rankings by a sum put NULL first (``sums`` of :func:`top_n`).
    """
    return F.coalesce(F.try_sum(col(c)), F.when(F.count(col(c)) == 0, F.lit(0).cast("long")))


def truncate_label(c: str | Column, n: int) -> Column:
    """Texts longer than ``n`` characters -> first ``n`` characters + ``...``."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def last_days(ts: str | Column, days: int | None, as_of: str | Column | None = None) -> Column:
    """Predicate ``ts >= as_of - days``; ``days=None`` keeps everything (NULL times too).

    ``as_of`` is a ``yyyy-MM-dd[ HH:mm:ss]`` string or a TIMESTAMP_NTZ column;
    the default is the current UTC time.
    """
    if days is None:
        return F.lit(True)
    ref = utc_now_ntz() if as_of is None else (parse_naive(F.lit(as_of)) if isinstance(as_of, str) else as_of)
    cutoff = F.timestamp_add("SECOND", F.lit(-int(days) * 86400), ref)
    return F.coalesce(col(ts) >= cutoff, F.lit(False))
