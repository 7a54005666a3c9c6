"""Rule-based classifiers as native column expressions.

The ordered keyword rules in :mod:`logsift.lookups` are compiled into one flat
``CASE WHEN`` over ``lower(text)`` that runs in generated code.  Its first,
always evaluated test (empty text) reads ``lower(text)`` twice, which lets
Catalyst's common-subexpression elimination compute it once for every rule.
(Nested under another ``CASE`` branch, the chain would be conditional and
``lower`` would run again for each keyword tested: twice as slow.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lookups
from .common import col


def _any_contains(text: Column, keywords) -> Column:
    cond = None
    for kw in keywords:
        c = text.contains(kw)
        cond = c if cond is None else (cond | c)
    return cond


def _compile(text: Column, rules, expr: Column | None = None) -> Column:
    """Ordered ``(keywords, target)`` rules -> CASE WHEN chain (continuing ``expr``
    when given); ``()`` keywords = default."""
    default = None
    for keywords, target in rules:
        value = _compile(text, target) if isinstance(target, list) else F.lit(target)
        if not keywords:
            default = value
            break
        cond = _any_contains(text, keywords)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    if expr is None:
        return default
    return expr.otherwise(default) if default is not None else expr


def _classify(c, rules, empty_label: str) -> Column:
    text = F.lower(col(c).cast("string"))
    # NULL or '' exactly when the raw text is; this first test makes `text` common
    return _compile(text, rules, F.when(text.isNull() | (text == ""), F.lit(empty_label)))


def classify_user_agent(c) -> Column:
    """Detailed user-agent class (CloudTrail), e.g. ``AWS CLI (Python)``, ``Browser (Chrome)``."""
    return _classify(c, lookups.UA_DETAILED_RULES, lookups.UA_DETAILED_EMPTY)


def classify_user_agent_coarse(c) -> Column:
    """Coarse user-agent class (S3): ``AWS CLI/SDK``, ``Browser``, ``Mobile``, ... ``Other``."""
    return _classify(c, lookups.UA_COARSE_RULES, lookups.UA_COARSE_EMPTY)


def split_requester(c) -> Column:
    """S3 requester -> ``struct(arn, ip)``.

    * NULL, ``''`` or ``-``  -> (``Unknown``, ``Unknown``)
    * IAM/STS ARN            -> (``<svc>:<type>/<name>``, ``N/A``)
    * IPv4 / full IPv6       -> (``N/A``, the address)
    * anything else          -> (the text, ``N/A``)
    """
    r = col(c)
    arn_re, ip_re = lookups.REQUESTER_ARN_PATTERN, lookups.REQUESTER_IP_PATTERN

    def pair(arn: Column, ip: Column) -> Column:
        return F.struct(arn.alias("arn"), ip.alias("ip"))

    # one CASE for both fields: each pattern is tested at most once per value
    # (two CASEs, one per field, would run both regexes twice)
    svc_type_name = F.concat(F.regexp_extract(r, arn_re, 1), F.lit(":"), F.regexp_extract(r, arn_re, 2), F.lit("/"),
                             F.regexp_extract(r, arn_re, 3))
    return (F.when(r.isNull() | (r == "") | (r == "-"), pair(F.lit("Unknown"), F.lit("Unknown")))
            .when(r.rlike(arn_re), pair(svc_type_name, F.lit("N/A")))
            .when(r.rlike(ip_re), pair(F.lit("N/A"), F.regexp_extract(r, ip_re, 0)))
            .otherwise(pair(r, F.lit("N/A"))))


def failure_category_match(text: Column, keywords) -> Column:
    """Case-insensitive regex match of any keyword (keywords are regexes, as in the source tool)."""
    return text.rlike("(?i)(" + "|".join(keywords) + ")")


def class_counts(df: DataFrame, column: str, classify, out: str, n: str) -> DataFrame:
    """``(out, n)``: rows by the class of ``column``.

    Rows are counted by the raw value first, and a class is found once for every
    distinct value instead of once for every row; a hot value is one row per task.
    """
    values = df.groupBy(column).agg(F.count(F.lit(1)).alias(n))
    return values.groupBy(classify(column).alias(out)).agg(F.sum(n).alias(n))
