"""Sharding along a Hilbert curve for multidimensional file pruning.

Each metadata dimension (source, lang, text size, id) is quantised at its own
quantiles, computed over all rows, to ``BITS`` bits; the codes are a point whose
index on the Hilbert curve is the sort key.  Rows are range-sorted by that
index across the cluster, numbered, and the order is cut into runs of equal
length, so a shard covers a compact box in every dimension and its files'
min/max statistics prune on any of them.

Law: ``rows``, shard sizes in rows differ by at most one.  A hot source is no
hot shard: its rows differ in the other dimensions and finally in id, so the
sort splits them.

Defined cases: a null dimension sorts before all values; null text has no bytes
(size 8, crc 0); rows that repeat get slots of their own; fewer rows than shards
leave some shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, global_order, numbered, schema_with

SHARDS = 24
BITS = 8
OVERHEAD = 8              # bytes that a row takes besides its text


def hilbert_index(codes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (rows of ``codes``, values below 2**bits).

    Skilling's transform (2004): undo the excess rotations bit by bit, Gray-decode, interleave.
    """
    x = codes.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        gray ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= gray
    index = np.zeros_like(gray)
    for b in reversed(range(bits)):
        for i in range(dims):
            index = index << 1 | (x[i] >> b & 1)
    return index


def string_edges(df: DataFrame, column: str, bits: int = BITS) -> list[bytes]:
    """The whole values at the quantiles of a string column over all its rows: fewer than 2**bits, in order."""
    held = df.select(F.col(column).cast("binary").alias("value"), F.monotonically_increasing_id().alias("tie")).where("value is not null")
    ordered, pos, total = global_order(held, ["value", "tie"], "strings")
    at = sorted({i * total >> bits for i in range(1, 1 << bits)})
    return sorted({bytes(r[0]) for r in ordered.where(F.col(pos).isin(at)).select("value").collect()})


def as_number(df: DataFrame, column: str) -> F.Column:
    """An order-preserving long: numbers as they are, strings by how many edges they reach; null before all."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        own = F.col(column).cast("binary")
        reached = [F.lit(e) for e in string_edges(df, column)]
        value = F.size(F.filter(F.array(*reached), lambda e: e <= own)).cast("long") if reached else F.lit(0).cast("long")
        value = F.when(own.isNotNull(), value)
    else:
        value = F.col(column).cast("long")
    return F.coalesce(value, F.lit(-(1 << 62)))


def curve_index(df: DataFrame, dims: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """``df`` with the Hilbert index of its quantised (numeric) columns ``dims``."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"c{i}") for i, c in enumerate(dims)]).first()
    edges = [np.unique(np.array(c if c is not None else [], np.int64)) for c in cuts]     # at most 2**bits numbers each
    schema = schema_with(df, **{name: "long"})

    def run(batches):
        for b in batches:
            codes = [np.searchsorted(e, b.column(c).to_numpy(), side="right") * ((1 << bits) - 1) // max(len(e), 1)
                     for c, e in zip(dims, edges)]
            yield b.append_column(name, pa.array(hilbert_index(np.stack(codes, axis=1), bits)))

    return df.mapInArrow(run, schema)


def shard_rows(df: DataFrame, dims: list[str], ties: list[str], shards: int = SHARDS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: equal runs along the curve over the numeric columns ``dims``."""
    curve = fresh(df, "curve")
    ordered, pos, total = global_order(curve_index(df, dims, name=curve), [curve, *ties], "hilbert")
    placed = ordered.withColumn("shard", F.expr(f"cast(`{pos}` * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("slot", F.col(pos) - first).select(*df.columns, "shard", "slot")


def measured(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Narrow rows to sort: a row number (``row`` of ``docs``, if named), the numbers that the curve needs, size and checksum of the text."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    return docs.select(number.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       as_number(docs, "source").alias("d_source"), as_number(docs, "lang").alias("d_lang"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("d_id"))


def op2(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    placed = shard_rows(measured(docs), ["d_source", "d_lang", "size", "d_id"], ["d_id", "row_id"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """``docs`` as Parquet, one folder per shard, rows in slot order."""
    row = fresh(docs, "row")
    rows = numbered(docs, row)
    place = shard_rows(measured(rows, row), ["d_source", "d_lang", "size", "d_id"], ["d_id", "row_id"], shards)
    place = place.select(F.col("row_id").alias(row), "shard", "slot")
    whole = rows.join(place, row).drop(row)
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
