"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Items of one length are interchangeable, and so are gaps of one size.  The
items are range-sorted by length across the cluster and numbered; one row per
length (at most ``capacity`` of them) then stands for all items.  A round takes
all lengths and all gap sizes at once: every length sweeps to its successor,
the smallest gap that holds it; lengths that want the same gap size are ranked,
longest first, and served while gaps last; the gaps shrink; whoever went away
empty asks again.  Where even the largest gap is too small, the longest such
length opens sequences.  A match covers a range of item numbers and a range of
sequences, so rounds handle any number of rows in memory bounded by
``capacity``, and the rows learn their place by looking up their number.

Defined cases: null text counts as empty (one piece, the end id); rows that
repeat are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_for, global_order, schema_with, stage
from .tokens import TOKENIZER, document_ids, encoder, pieces_of

CAPACITY = 1024


def best_fit_rounds(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pack ``counts[length]`` items: matches (length, first item, items, first sequence, offset), and the sequences used."""
    waiting = {length: (0, n) for length, n in counts.items() if n}       # next item of the length, items left
    gaps: dict[int, list[tuple[int, int]]] = {}                           # gap size -> ranges (first sequence, sequences)
    matches, used = [], 0
    while waiting:
        lengths = np.array(sorted(waiting, reverse=True))
        sizes = np.array(sorted(gaps), dtype=np.int64)
        successor = np.searchsorted(sizes, lengths, side="left")
        unserved = lengths[successor == len(sizes)]
        grown: dict[int, list[tuple[int, int]]] = {}
        for length, at in zip(lengths.tolist(), successor.tolist()):      # longest first within a gap size
            if at == len(sizes):
                continue
            ranges = gaps.get(size := int(sizes[at]))
            first, left = waiting[length]
            while left and ranges:
                seq, n = ranges.pop()
                take = min(left, n)
                if take < n:
                    ranges.append((seq + take, n - take))
                matches.append((length, first, take, seq, capacity - size))
                if size > length:
                    grown.setdefault(size - length, []).append((seq, take))
                first, left = first + take, left - take
            if left:
                waiting[length] = (first, left)
            else:
                del waiting[length]
            if not ranges:
                gaps.pop(size, None)
        if len(unserved):
            longest = int(unserved[0])
            each = capacity // longest
            n = -(-waiting[longest][1] // each)
            grown.setdefault(capacity, []).append((used, n))
            used += n
        for size, ranges in grown.items():
            gaps.setdefault(size, []).extend(ranges)
    return matches, used


def pack(items: DataFrame, length: str, ties: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``items`` (lengths 1 to ``capacity``) with sequence_id and offset; ``ties`` order items of one length."""
    ordered, pos_name, _ = global_order(items, [F.col(length).desc(), *map(F.col, ties)], "packing")
    counts = {r[0]: r[1] for r in ordered.groupBy(length).count().collect()}     # at most ``capacity`` rows
    matches, _ = best_fit_rounds(counts, capacity)
    begin, at = {}, 0
    for size in sorted(counts, reverse=True):
        begin[size], at = at, at + counts[size]
    table = np.array(sorted((begin[size] + first, seq, off) for size, first, _, seq, off in matches),
                     np.int64).reshape(len(matches), 3)
    schema = schema_with(items, sequence_id="long", offset="long")

    def place(batches):
        for b in batches:
            pos = b.column(pos_name).to_numpy()
            row = table[np.searchsorted(table[:, 0], pos, side="right") - 1]
            out = b.select(items_columns)
            out = out.append_column("sequence_id", pa.array(row[:, 1] + pos - row[:, 0]))
            yield out.append_column("offset", pa.array(row[:, 2]))

    items_columns = items.columns
    return ordered.select(*items_columns, pos_name).mapInArrow(place, schema)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False,
                 id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, doc_id, piece, start, length, ids_crc32 of every piece; ``with_ids`` adds its ids (uint32, little-endian)."""
    narrow = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text).cast("string").alias("text"))
    names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        encode = encoder(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for row, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                ids = document_ids(encode, text)
                for i, (start, n) in enumerate(pieces_of(len(ids), capacity)):
                    part = ids[start:start + n].tobytes()
                    rows.append((row, doc, i, start, n, zlib.crc32(part)) + (part,) * with_ids)
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return narrow.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document's pieces with the sequence and the offset each goes to."""
    pieces = stage(token_pieces(docs, capacity, tokenizer), "pieces", files_for(docs))
    return pack(pieces, "length", ["doc_id", "row_id", "piece"], capacity).drop("row_id")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces that carry ``ids`` to one row per sequence: its ids and where each piece begins."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    return whole.select("sequence_id", F.expr("aggregate(p, binary(''), (a, x) -> concat(a, x.ids))").alias("ids"),
                        F.col("p.offset").alias("offsets"), F.col("p.doc_id").alias("doc_ids"), F.col("p.piece").alias("pieces"))
