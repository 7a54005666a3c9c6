"""Exact dedup by content sort.

Texts count as equal when they are identical after deleting white space
(space and 0x09-0x0D); null counts as empty.  Of equal texts the row with the
most code points in its original text stays, then the smallest id.

1. One pass normalises whole texts and collapses copies inside each scan task,
   so a text sends its bytes to the sort once per task however often it occurs
   (a hot group of copies never meets in one task).
2. The surviving representatives are range-partitioned by sampled splitters on
   the first ``PREFIX`` normalised bytes (then the digest, which splits a common
   opening) and sorted externally, which places equals next to each other; a
   run of equals never crosses a partition.  Splitters stay short, so what the
   driver samples doesn't follow the texts' length.
3. Neighbours are compared in full; a run takes its first row as leader.
4. Keeper and size are aggregated per leader over narrow rows; rows take the
   answer of their representative (an equi-join on its number).

Defined cases: all texts that normalise to nothing form one group; rows that
repeat, ``doc_id`` included, are counted as rows and exactly one of them is
marked as kept; a null id sorts after all others; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, files_for, fresh, numbered, partitions, raw, stage

WHITE = b" \t\n\x0b\x0c\r"
PREFIX = 32
_LAST = (1 << 63) - 1     # order value of a null id


def _collapse(narrow: DataFrame) -> DataFrame:
    """Per row: row_id, doc_id, n_chars, sha256, rep (row_id of the task's first equal text).

    The representative also carries ``norm``; other rows leave it null.
    """
    def run(batches):
        first: dict[bytes, int] = {}     # digest -> representative, for the rows of this task
        for b in batches:
            texts = raw(b.column("text"))
            ids = b.column("row_id").to_pylist()
            reps, digests, norms, chars = [], [], [], []
            for row_id, t in zip(ids, texts):
                norm = t.translate(None, WHITE)
                digest = hashlib.sha256(norm).digest()
                rep = first.setdefault(digest, row_id)
                reps.append(rep)
                digests.append(digest)
                norms.append(norm if rep == row_id else None)
                chars.append(len(t.decode("utf-8", "replace")))
            yield pa.record_batch([b.column("row_id"), b.column("doc_id"), pa.array(chars, pa.int64()),
                                   pa.array(digests, pa.binary()), pa.array(reps, pa.int64()),
                                   pa.array(norms, pa.binary())],
                                  names=["row_id", "doc_id", "n_chars", "digest", "rep", "norm"])

    return narrow.mapInArrow(run, "row_id long, doc_id long, n_chars long, digest binary, rep long, norm binary")


def _neighbours(reps: DataFrame) -> DataFrame:
    """Runs of equal neighbours in sorted order: rep -> leader, the run's first representative."""
    def run(batches):
        last, leader = None, None
        for b in batches:
            reps, leaders = b.column("rep").to_pylist(), []
            for norm, rep in zip(raw(b.column("norm")), reps):
                if leader is None or norm != last:
                    last, leader = norm, rep
                leaders.append(leader)
            yield pa.record_batch([b.column("rep"), pa.array(leaders, pa.int64())], names=["rep", "leader"])

    n = partitions(reps.sparkSession)
    keys = [F.substring("norm", 1, PREFIX).alias("lead"), F.col("digest")]
    ordered = reps.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "norm", "rep")
    return ordered.select("rep", "norm").mapInArrow(run, "rep long, leader long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 and row_id (``row`` of ``docs``, if named)."""
    narrow = docs.select((F.monotonically_increasing_id() if row is None else F.col(row)).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text).cast("binary").alias("text"))
    rows = stage(_collapse(narrow), "exact-rows", files_for(docs))
    leaders = stage(_neighbours(rows.where("norm is not null").select("rep", "digest", "norm")), "exact-leaders",
                    files_for(rows.drop("norm"), 1))
    order = F.struct((-F.col("n_chars")).alias("a"), F.coalesce("doc_id", F.lit(_LAST)).alias("b"), F.col("row_id").alias("c"))
    # copies within a task first, then the few representatives of a text
    local = rows.groupBy("rep").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows"))
    groups = local.join(leaders, "rep").groupBy("leader").agg(F.min("best").alias("best"), F.sum("rows").alias("group_size"))
    settled = leaders.join(groups, "leader").select(
        "rep", F.col("best.c").alias("keep_row"), F.when(F.col("best.b") != _LAST, F.col("best.b")).alias("keep_id"), "group_size")
    return (rows.drop("norm").join(settled, "rep")
            .select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "row_id"))


def op10(docs: DataFrame) -> DataFrame:
    return compact(exact_groups(docs).drop("row_id"), files_for(docs))


def keep_distinct(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    row = fresh(docs, "row")
    rows = numbered(docs, row)
    kept = exact_groups(rows, id_col, text, row).where("kept").select(F.col("row_id").alias(row))
    return compact(rows.join(kept, row, "left_semi").drop(row), files_for(docs))
