"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A source's budget is a number of words.  Sources share all words by weight; a
budget stops at ``most`` times the source's size and what it leaves is shared
again by weight until no budget is above.

1. One pass measures the rows: words, quality weight, and the key
   -ln(u) / weight, where u in (0, 1) comes from a digest of seed, id and text.
   The smallest keys of a source are a weighted sample without replacement.
2. Sizes are added up per source; budgets come from a few rounds, each one
   partially aggregated row (``word_budgets``).
3. Rows are range-sorted by source and key.  Sampled splitters cut a hot source
   into many tasks.  A row's words before it, in its source, are a running sum
   within its sorted run plus the sums of the runs before.
4. A budget first takes complete epochs of its source, every row once each;
   what is left of it is taken in key order, and the row that reaches the budget
   is taken up to it (its first words).

Defined cases: null text counts as empty; rows without words are in the mix with
nothing to take; a null source is a source of its own, after all others; rows
that repeat are rows of their own (equal ones share their key, and which of them
the budget cuts can't be told apart); ids may be null; only the named columns are
read, so other columns may have any name; an empty table, or one without any
word, gives zero budgets.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import compact, files_for, partitions, stage

WEIGHTS = (1, 2, 3)       # of the sources by code point, repeating
MOST = 3                  # times its size that a source may be taken
SEED = "mix-1"
_WHITE = " \t\n\x0b\f\r"


def quality(words: Column) -> Column:
    """Weight of a document: from 0.1 for one word repeated on and on to 1 for words that are all different."""
    return F.lit(0.1) + F.lit(0.9) * F.size(F.array_distinct(words)) / F.size(words)


def measured(docs: DataFrame, id_col: str, text: str, source: str, weight: Column | None, keep: tuple[str, ...], seed: str) -> DataFrame:
    """Per row: code (its source, null last), size, key, digest, doc_id and ``row``, the columns of ``keep``."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1")).alias("code"),
                       F.struct(*[F.col(c) for c in keep] or [F.lit(True).alias("present")]).alias("row"),
                       (F.lit(None) if weight is None else weight).cast("double").alias("weight"))
    trimmed = F.btrim("text", F.lit(_WHITE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    sized = read.select("doc_id", "code", "row", (F.size(words) - (trimmed == "").cast("int")).cast("long").alias("size"),
                        F.coalesce("weight", quality(words)).alias("weight"), digest.alias("digest"))
    u = (F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return sized.select("doc_id", "code", "row", "size", "digest", (-F.log(u) / F.col("weight")).alias("key"))


def _in_runs(df: DataFrame, keys: list, label: str, files: int) -> DataFrame:
    """``df`` range-sorted by ``keys`` and staged, with its run (the range) and its place in the run."""
    place = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    ordered = ordered.withColumn("place", place)
    return stage(ordered.withColumn("run", F.shiftright("place", 33)), label, files)


def source_weights(sizes: DataFrame, weights: tuple[int, ...], files: int) -> DataFrame:
    """code, source_size to the same and the weight of the source's place among the sorted sources."""
    runs = _in_runs(sizes, ["code"], "mix-sources", files)
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)      # a row per range
    starts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)
    cycle = F.array(*map(F.lit, weights))
    return runs.join(F.broadcast(starts), "run").select("code", "source_size", F.get(cycle, (at % len(weights)).cast("int")).alias("weight"))


def word_budgets(sources: DataFrame, most: int) -> DataFrame:
    """code, source_size, weight to the same and ``target``, by rounds of exact sums over the sources."""
    whole, shares = sources.agg(F.sum(F.col("source_size").cast("decimal(38,0)")), F.sum("weight")).first()
    total = int(whole or 0)
    level = Fraction(total, int(shares)) if shares else Fraction(0)
    cap = F.col("source_size").cast("decimal(20,0)") * F.lit(Decimal(most))
    while total:
        stopped = F.lit(Decimal(level.numerator)) * F.col("weight").cast("decimal(6,0)") > cap * F.lit(Decimal(level.denominator))
        held, rest = sources.agg(F.sum(F.when(stopped, cap).cast("decimal(38,0)")), F.sum(F.when(~stopped, F.col("weight")))).first()
        raised = Fraction(total - int(held or 0), int(rest)) if rest else level
        if raised == level:
            break
        level = raised
    share = F.col("weight").cast("double") * F.lit(float(level))
    return sources.withColumn("target", F.least(share, F.col("source_size").cast("double") * F.lit(float(most))))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
        keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, epochs (complete ones) and row (the columns of ``keep``).

    ``weight`` is a column of ``docs``, above zero, in place of :func:`quality`.
    """
    files = files_for(docs)
    rows = stage(measured(docs, id_col, text, source, weight, keep, seed), "mix-rows", files)
    sizes = rows.groupBy("code").agg(F.sum("size").alias("source_size"))
    budgets = word_budgets(stage(source_weights(sizes, weights, files), "mix-weights", files), most)
    runs = _in_runs(rows, ["code", "key", "digest"], "mix-runs", files)
    earlier = Window.partitionBy("code").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)     # a row per source and range
    held = runs.groupBy("run", "code").agg(F.sum("size").alias("n"))
    starts = held.select("run", "code", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).join(budgets, "code")
    ahead = Window.partitionBy("run", "code").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0))).join(starts, ["run", "code"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    told = placed.withColumn("epochs", epochs)
    left = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long") - F.col("start") - F.col("ahead")
    part = F.greatest(F.lit(0), F.least("size", left))
    out = told.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
                      "epochs", "row")
    return compact(out, files)


def copies(mixed: DataFrame) -> DataFrame:
    """The rows of the mix as often as it takes them: ``row`` and ``words``, how many of its first words count."""
    times = F.expr("filter(sequence(0L, epochs), i -> taken > i * size)")
    each = mixed.where("taken > 0").withColumn("epoch", F.explode(times))
    return each.select("doc_id", "row", "epoch", F.least("size", F.col("taken") - F.col("epoch") * F.col("size")).alias("words"))


def op13(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("row")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def oracle_sql() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size,
    CASE WHEN len({_WORDS}) = 0 THEN 1::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * len(list_distinct({_WORDS})) / len({_WORDS}) END AS w,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest FROM documents),
k AS (SELECT *, -ln((('0x' || substr(digest, 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE) / w AS key FROM d),
s AS (SELECT source, sum(size) AS source_size,
    [{weights}][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)})::INT] AS weight FROM d GROUP BY source),
-- sources by how early they stop; the first that the level of all from it on doesn't stop sets the level
o AS (SELECT *, {MOST} * source_size AS cap, (sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER before, 0))::DOUBLE
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM s WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, cap / weight) FILTER (WHERE weight * level <= cap) AS level FROM o),
t AS (SELECT source, source_size, least(weight * l.level, {MOST} * source_size)::DOUBLE AS target FROM s, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, epochs, (epochs * size + greatest(0, least(size,
    round(target - epochs * source_size)::BIGINT - coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, digest
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source"""
