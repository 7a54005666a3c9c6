"""Directory scans: recursive listing, file-name rules, plain or gzip text.

Files are read with Spark's text source.  The file-name rule is a predicate on
the hidden ``_metadata.file_name`` column; Spark evaluates it while listing,
so files that do not qualify are never opened (``DataFilters`` in the plan).
Gzip is decoded by the Hadoop codec chosen from the extension.

For many small delivery files, raise ``spark.sql.files.openCostInBytes`` /
``maxPartitionBytes`` so one task packs many files.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import lookups


def _suffix_regex(suffixes) -> str:
    return "(?i:(" + "|".join(re.escape(s) for s in suffixes) + ")$)"


class Rejects:
    """Counts, in the same pass that parses, what could not be read as records.

    Give one to a reader, run the action, then ask :meth:`total`.
    """

    def __init__(self):
        self._seen: list[Observation] = []

    def watch(self, df: DataFrame, rejected: Column) -> DataFrame:
        """``df`` unchanged; adds ``rejected`` (a number per row) up while it runs."""
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, F.coalesce(F.sum(rejected), F.lit(0)).cast("long").alias("rejected"))

    def total(self) -> int:
        """After the action: the rejected lines, documents and values."""
        return sum(seen.get["rejected"] for seen in self._seen)


CLOUDTRAIL_NAME_REGEX = _suffix_regex(lookups.CLOUDTRAIL_FILE_SUFFIXES)
# suffix rule is case-insensitive, the dated-name rule is a prefix match (upper-case hex)
FLOW_NAME_REGEX = _suffix_regex(lookups.FLOW_FILE_SUFFIXES) + "|^" + lookups.FLOW_FILE_NAME_PATTERN


def read_text_files(spark: SparkSession, path: str | list[str], name_regex: str, wholetext: bool = False,
                    ignore_corrupt: bool = False, options: dict | None = None, where: Column | None = None,
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """``(value, source_file)`` rows from every matching file under ``path``.

    ``wholetext=True`` gives one row per file (whole document), else one row
    per line.  Of several paths, missing ones are skipped; if none is there, the
    error is ``FileNotFoundError``.  A damaged file (e.g. truncated gzip), a file that
    vanishes and a failing store end the job after its retries.  With
    ``ignore_corrupt`` a damaged file keeps the rows read before the damage and
    the scan goes on with the next file, without a count of what was lost.
    ``where`` is another rule on ``_metadata``, ``extra`` are columns made from it.
    """
    reader = (spark.read.option("recursiveFileLookup", "true")
              .option("ignoreCorruptFiles", str(ignore_corrupt).lower()))
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    paths = [path] if isinstance(path, str) else list(path)
    try:
        # wholetext must be passed as an argument: text() overrides the option
        raw = reader.text(paths, wholetext=wholetext)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "Path does not exist" not in str(exc):
            raise
        if len(paths) <= 1:
            raise FileNotFoundError(f"no such path: {', '.join(paths)}") from exc
        # some of several paths are missing: read the others, skip the missing ones
        found = []
        for p in paths:
            try:
                found.append(read_text_files(spark, p, name_regex, wholetext, ignore_corrupt, options, where, extra))
            except FileNotFoundError:
                continue
        if not found:
            raise FileNotFoundError(f"no such path: {', '.join(paths)}") from exc
        return reduce(DataFrame.unionByName, found)
    named = F.col("_metadata.file_name").rlike(name_regex)
    return (raw.filter(named if where is None else named & where)
               .select(F.col("value"), F.col("_metadata.file_name").alias("source_file"), *[c.alias(n) for n, c in (extra or {}).items()]))
