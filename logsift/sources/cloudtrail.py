"""CloudTrail source: JSON documents -> one row per event record.

Accepted document shapes (one document per file):

* ``{"Records": [ ... ]}`` (compact or pretty-printed),
* a top-level array of records,
* a single record object,
* JSON Lines (one value per line; lines that do not parse are skipped;
  a ``Records`` wrapper on a line is unpacked too).

A document is only cut: ``from_json`` with an array of strings passes each
record on as text, so neither a document's size nor one odd record costs the
others.  Every record is then decoded by itself into a struct of the wanted
fields; a repeated key takes its last value.  Everything runs per row inside
the scan stage: no shuffle.  ``.jsonl`` files (and any other files whose names
match ``lines_regex``) are read line by line, so a large JSON-Lines file is
split across tasks; so are large files of other names that turn out to hold JSON
Lines (:func:`large_line_files`).  :func:`cloudtrail_rejects` lists what was not decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import blank_to_null, parse_iso_utc, strip_ws
from ..operators.enrich import local_time
from ..schemas import CLOUDTRAIL_COLUMNS, IDENTITY_COLUMNS, IDENTITY_KEYS, IDENTITY_PREFIX
from .files import CLOUDTRAIL_NAME_REGEX, Rejects, read_text_files

# record key -> (column, kind); kind: s = scalar text, j = JSON text, b = boolean
_FIELDS = [
    ("eventTime", "event_time_text", "s"), ("awsRegion", "aws_region", "s"), ("eventName", "event_name", "s"),
    ("eventSource", "event_source", "s"), ("sourceIPAddress", "source_ip_address", "s"),
    ("userAgent", "user_agent", "s"), ("requestParameters", "request_elements", "j"),
    ("responseElements", "response_elements", "j"), ("eventType", "event_type", "s"),
    ("eventID", "event_id", "s"), ("errorCode", "error_code", "s"), ("errorMessage", "error_message", "s"),
    ("requestID", "request_id", "s"), ("eventCategory", "event_category", "s"), ("readOnly", "read_only", "b"),
    ("resources", "resources", "j"), ("serviceEventDetails", "service_event_details", "j"),
    ("additionalEventData", "additional_event_data", "j"), ("apiVersion", "api_version", "s"),
    ("managementEvent", "management_event", "b"), ("insightDetails", "insight_details", "j"),
    ("recipientAccountId", "recipient_account_id", "s"),
    ("sessionCredentialDurationSeconds", "session_credential_duration_seconds", "s"),
    ("sessionIssuer", "session_issuer", "j"), ("sessionMfaAuthenticated", "session_mfa_authenticated", "s"),
    ("sessionContext", "session_context", "j"), ("tlsDetails", "tls_details", "j"),
    ("vpcEndpointId", "vpc_endpoint_id", "s"), ("addendum", "addendum", "j"),
    ("edgeDeviceDetails", "edge_device_details", "j"), ("eventVersion", "event_version", "s"),
]
# JSON renderings of "empty" values, stored as NULL like missing ones
_EMPTY_JSON = ["", "{}", "[]", "null", "false", "0", '""']


LINES_REGEX = r"(?i:\.jsonl$)"
LARGE_BYTES = 16 << 20     # files above it are read whole only if they hold one document
LARGE_GZIP = 1 << 20       # of gzip files, which hold about 16 times as much
BY_LINE = {"lineSep": "\n"}  # the line ends that documents are split at
_BAD = "_bad"
_ROOT = f"struct<Records:array<string>,{_BAD}:string>"
_OPTIONS = {"columnNameOfCorruptRecord": _BAD}


def _drop_empty_json(j: Column) -> Column:
    """Compact JSON text -> itself, or NULL for empty values (``{}``, ``[]``,
    ``""``, ``0``, ``false``, null).  Apply it to a column that already holds
    the text: over an expression the conversion would run twice."""
    return F.when(~j.isin(_EMPTY_JSON), j)


def _compact(text: Column) -> Column:
    """JSON text as compact JSON; text that can't be normalised (a repeated key) stays as it is."""
    nested = text.startswith("{") | text.startswith("[")
    return F.when(nested, F.coalesce(F.to_json(F.try_parse_json(text)), text)).otherwise(text)


def _parses(text: Column) -> Column:
    """Text is one JSON object, or starts with one."""
    probe = F.from_json(text, f"struct<eventID:string,{_BAD}:string>", _OPTIONS)
    return text.startswith("{") & probe.isNotNull() & probe[_BAD].isNull()


def _wrapped(root: Column, text: Column) -> Column:
    """A JSON object decoded as ``_ROOT`` -> the texts of its records: the ``Records`` array, else itself;
    NULL if it isn't JSON."""
    named = root["Records"].isNull() & text.contains('"Records"') & F.array_contains(F.json_object_keys(text), "Records")
    return (F.when(root.isNull() | root[_BAD].isNotNull(), F.lit(None).cast("array<string>"))
            .when(named, F.array().cast("array<string>"))           # Records: null is a wrapper without records
            .otherwise(F.coalesce(root["Records"], F.array(text))))


def _opened(docs: DataFrame) -> DataFrame:
    """``(value, source_file)`` documents -> ``records`` (array of texts, NULL where the text isn't JSON) of
    every document, or of every line of JSON Lines.

    JSON Lines is recognised when the document does not parse as one value, or
    when it has more than one non-blank line and its first line parses alone
    (a complete value followed by more content cannot be one JSON document).
    """
    text = F.col("value")
    # columns of their own: inside the generator every reference would run them again
    staged = docs.select("value", "source_file", strip_ws(text).alias("stripped"))
    staged = staged.select("value", "source_file", F.substring("stripped", 1, 1).alias("head"), F.col("stripped").contains("\n").alias("more_lines"),
                           strip_ws(F.when(F.col("stripped").contains("\n"), F.substring_index("stripped", "\n", 1))).alias("first"))
    # a document on one line is parsed once, as a whole
    staged = staged.withColumn("first_parses", F.coalesce(F.when(F.col("more_lines"), _parses(F.col("first"))), F.lit(False)))
    staged = staged.withColumn("root", F.when(F.col("head") == "{", F.from_json(text, _ROOT, _OPTIONS)))
    staged = staged.withColumn("whole", F.when(F.col("head") == "[", F.from_json(text, "array<string>"))
                               .otherwise(_wrapped(F.col("root"), text)))
    lines = F.col("whole").isNull() | (F.col("more_lines") & F.col("first_parses"))
    no_line = F.array(F.lit(None).cast("string"))
    # below the generator: what stands beside it is copied to every line
    cut = staged.select(
        F.when(~lines, F.col("whole")).alias("whole"), "source_file",
        F.when(lines, F.transform(F.split(text, "\n"), lambda ln: strip_ws(ln))).otherwise(no_line).alias("lines"))
    # an expression is exploded: for a column, Spark would infer a filter on its size and run everything above in it again
    line = F.explode(F.filter("lines", lambda ln: ln.isNull() | (ln != "")))
    by_line = _opened_lines(cut.select("whole", "source_file", line.alias("line")))
    return by_line.select(F.coalesce("whole", "records").alias("records"), "source_file")


def _opened_lines(lines: DataFrame) -> DataFrame:
    """``line`` -> the ``records`` in it, beside the other columns."""
    line = F.col("line")
    staged = lines.withColumn("root", F.when(line.startswith("{"), F.from_json(line, _ROOT, _OPTIONS)))
    return staged.withColumn("records", _wrapped(F.col("root"), line)).drop("root", "line")


def _is_object(rec: Column) -> Column:
    return F.coalesce(rec.startswith("{"), F.lit(False))


def document_records(docs: DataFrame, rejects: Rejects | None = None) -> DataFrame:
    """``(value, source_file)`` whole documents -> ``(rec, source_file)``: the text of every record object."""
    return _records(_opened(docs), rejects)


def line_records(lines: DataFrame, rejects: Rejects | None = None) -> DataFrame:
    """``(value, source_file)`` JSON-Lines rows -> ``(rec, source_file)``."""
    return _records(_opened_lines(_line_texts(lines)), rejects)


def _line_texts(lines: DataFrame) -> DataFrame:
    return lines.select(strip_ws("value").alias("line"), "source_file").where("line <> ''")


def _others() -> Column:
    """Values of a decoded text that are no record objects."""
    return F.size(F.filter("records", lambda r: ~_is_object(strip_ws(r))))


def _records(opened: DataFrame, rejects: Rejects | None = None) -> DataFrame:
    if rejects is not None:
        opened = rejects.watch(opened, F.when(F.col("records").isNull(), 1).otherwise(_others()))
    return opened.select(F.explode(F.filter("records", lambda r: _is_object(strip_ws(r)))).alias("rec"), "source_file")


def cloudtrail_rejects(docs: DataFrame, lines: bool = False) -> DataFrame:
    """``(source_file, reason, rejected)``: texts that aren't JSON and values that aren't record objects, per file.

    ``docs`` are whole documents, or JSON-Lines rows with ``lines``.
    """
    opened = _opened_lines(_line_texts(docs)) if lines else _opened(docs)
    reasons = F.array(F.struct(F.lit("not JSON").alias("reason"), F.when(F.col("records").isNull(), 1).otherwise(0).alias("n")),
                      F.struct(F.lit("not an object").alias("reason"), F.when(F.col("records").isNotNull(), _others()).otherwise(0).alias("n")))
    return (opened.select("source_file", F.explode(reasons).alias("r")).where("r.n > 0")
            .groupBy("source_file", F.col("r.reason").alias("reason")).agg(F.sum("r.n").alias("rejected")))


def _last_wins(m: Column) -> Column:
    """A map decoded from JSON may hold a repeated key; its last value counts."""
    keys = F.map_keys(m)
    entries = F.filter(F.map_entries(m), lambda e, i: F.get(F.reverse(keys), F.array_position(F.reverse(keys), e["key"]).cast("int") - 1).isNotNull()
                       & (F.size(keys) - F.array_position(F.reverse(keys), e["key"]) == i))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(entries)).otherwise(m)


def project_records(records: DataFrame, offsets: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """``(rec, source_file)`` -> canonical ``cloudtrail`` rows.

    ``columns`` names the canonical columns that are wanted (default all); only their keys are decoded.
    """
    wanted = [(key, name, kind) for key, name, kind in _FIELDS if columns is None or name in columns
              or (name in ("event_time_text", "aws_region") and {"event_time", "event_time_local"} & set(columns))]
    identity = columns is None or "user_identity" in columns or bool({n for n, _ in IDENTITY_COLUMNS} & set(columns))
    kinds = "struct<" + ",".join([f"{key}:string" for key, _, _ in wanted] + ["userIdentity:map<string,string>"] * identity) + ">"
    typed = records.select(F.from_json("rec", kinds).alias("r"), "source_file")
    r = F.col("r")
    cols = []
    for key, name, kind in wanted:
        if kind == "j":
            cols.append(_compact(r[key]).alias(name))          # empties dropped below
        elif kind == "s":
            cols.append(blank_to_null(r[key]).alias(name))
        else:
            cols.append(F.lower(r[key]).try_cast("boolean").alias(name))
    if identity:
        cols.append(F.transform_values(_last_wins(r["userIdentity"]), lambda k, v: _compact(blank_to_null(v))).alias("user_identity"))
    staged = typed.select(*cols, "source_file")
    out = {name: _drop_empty_json(F.col(name)) if kind == "j" else F.col(name) for _, name, kind in wanted if name != "event_time_text"}
    if "event_time_text" in staged.columns:
        out["event_time"] = parse_iso_utc("event_time_text")
        out["event_time_local"] = local_time(parse_iso_utc("event_time_text"), F.col("aws_region"), offsets)
    if identity:
        # the map is built in the projection above and tested here: used twice in
        # one expression it would be built twice
        out["user_identity"] = F.when(F.size("user_identity") > 0, F.col("user_identity"))
    out["source_file"] = F.col("source_file")
    order = [n for n, _ in CLOUDTRAIL_COLUMNS if n in out and (columns is None or n in columns or n in ("source_file", "user_identity"))]
    return staged.select(*[out[n].alias(n) for n in order])


def with_identity_columns(df: DataFrame) -> DataFrame:
    """Add ``user_type, principal_id, user_arn, account_id, user_name`` from ``user_identity``."""
    if "user_identity" not in df.columns:
        return df
    return df.withColumns({name: F.try_element_at("user_identity", F.lit(key)) for name, key in IDENTITY_COLUMNS})


def parse_cloudtrail_docs(docs: DataFrame, offsets: dict | None = None, columns: list[str] | None = None,
                          rejects: Rejects | None = None) -> DataFrame:
    """Whole documents ``(value, source_file)`` -> ``cloudtrail`` rows with identity columns."""
    return with_identity_columns(project_records(document_records(docs, rejects), offsets, columns))


def parse_cloudtrail_lines(lines: DataFrame, offsets: dict | None = None, columns: list[str] | None = None,
                           rejects: Rejects | None = None) -> DataFrame:
    """JSON-Lines rows ``(value, source_file)`` -> ``cloudtrail`` rows with identity columns."""
    return with_identity_columns(project_records(line_records(lines, rejects), offsets, columns))


def is_large(size: Column, gzip: Column) -> Column:
    return size > F.when(gzip, LARGE_GZIP).otherwise(LARGE_BYTES)


def large_line_files(spark: SparkSession, path: str | list[str], name_regex: str, lines_regex: str = LINES_REGEX, **options) -> list[str]:
    """The large files (:func:`is_large`) that :func:`_opened` would read line by line: more than one line that isn't blank,
    the first of which parses alone.  ``lines_regex`` names those that need no look.

    The lines that begin in the first block of these files are parsed for it; a row per file comes to the driver,
    which has listed the files.
    """
    name = F.col("_metadata.file_name")
    large = is_large(F.col("_metadata.file_size"), name.rlike(r"(?i:\.gz$)"))
    options = options | {"options": (options.get("options") or {}) | BY_LINE}
    rows = read_text_files(spark, path, name_regex, where=large & ~name.rlike(lines_regex),
                           extra={"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start")}, **options)
    # ids rise along a block, which one task reads
    lines = rows.where("start = 0").select("file", F.monotonically_increasing_id().alias("id"), strip_ws("value").alias("line")).where("line <> ''")
    seen = lines.select("file", "id", _parses(F.col("line")).alias("parses")).groupBy("file").agg(
        F.min("id").alias("first"), F.min(F.when(F.col("parses"), F.col("id"))).alias("parsed"), F.count(F.lit(1)).alias("n"))
    return [r.file for r in seen.where("first = parsed and n > 1").select("file").collect()]


def raw_cloudtrail(spark: SparkSession, path: str | list[str], lines_regex: str | None = LINES_REGEX,
                   **options) -> tuple[DataFrame, DataFrame | None]:
    """The files of a CloudTrail directory as (whole documents, JSON-Lines rows)."""
    if lines_regex is None:
        return read_text_files(spark, path, CLOUDTRAIL_NAME_REGEX, wholetext=True, **options), None
    by_line, file = F.col("_metadata.file_name").rlike(lines_regex), F.col("_metadata.file_path")
    lines = read_text_files(spark, path, CLOUDTRAIL_NAME_REGEX, where=by_line, **options)
    large = large_line_files(spark, path, CLOUDTRAIL_NAME_REGEX, lines_regex, **options)
    if not large:
        return read_text_files(spark, path, CLOUDTRAIL_NAME_REGEX, wholetext=True, where=~by_line, **options), lines
    docs = read_text_files(spark, path, CLOUDTRAIL_NAME_REGEX, wholetext=True, where=~by_line & ~file.isin(large), **options)
    options = options | {"options": (options.get("options") or {}) | BY_LINE}
    return docs, lines.unionByName(read_text_files(spark, path, CLOUDTRAIL_NAME_REGEX, where=file.isin(large), **options))


def read_cloudtrail(spark: SparkSession, path: str | list[str], lines_regex: str | None = LINES_REGEX,
                    offsets: dict | None = None, columns: list[str] | None = None, rejects: Rejects | None = None,
                    jsonl_by_line: bool = True, **options) -> DataFrame:
    """Scan a CloudTrail directory (recursive; ``.json .jsonl .json.gz``, any case).

    Files are read as whole documents, one per row; those whose names match
    ``lines_regex`` (default ``.jsonl``) line by line: splittable, no per-file
    memory bound.  Large files of other names that hold JSON Lines are read by line,
    too; name them in ``lines_regex`` to save the look at them, which runs at once.
    ``jsonl_by_line=False`` reads everything as documents.
    """
    docs, lines = raw_cloudtrail(spark, path, lines_regex if jsonl_by_line else None, **options)
    out = parse_cloudtrail_docs(docs, offsets, columns, rejects)
    return out if lines is None else out.unionByName(parse_cloudtrail_lines(lines, offsets, columns, rejects))


def identity_keys(df: DataFrame) -> DataFrame:
    """``(key, events)``: every key that some ``user_identity`` has, in one pass (a row per task and key is shuffled).

    Give the keys to :func:`identity_wide` or to the ordered export to get a column for each.
    """
    keys = df.select(F.explode(F.map_keys("user_identity")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("events"))


def identity_wide(df: DataFrame, keys: list[str] = IDENTITY_KEYS) -> DataFrame:
    """Wide view of ``user_identity``: a ``userIdentity.<key>`` column for each of ``keys``.

    The default is the documented elements of a user identity.  The map itself
    stays, so no other key is lost, and no pass over the data is needed.
    """
    return df.select("*", *[F.try_element_at("user_identity", F.lit(k)).alias(f"{IDENTITY_PREFIX}{k}") for k in keys])
