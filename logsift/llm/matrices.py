"""Packed token-id matrices in binary form.

Documents stream through their scan tasks and are packed in blocks of about
``rows * width`` ids, so nothing is shuffled and a task holds one block.  In a
block, pieces go longest first into the row that fits best: a segment tree over
free room answers "smallest room of at least n" in log(width) steps.  A
document longer than a row is cut into pieces that keep its id order; the
pieces' starts put it together again.

One output row is one row of a matrix, which ``block`` (number of the input row
of its first piece) and ``block_start`` (that piece's start) name: ``ids`` and ``positions`` are
little-endian unsigned integers of ``width`` entries each (padded with ``PAD``
and 0), ``cu_seqlens`` the cumulative segment lengths from 0; positions begin
at 0 at every segment.

Defined cases: null text counts as empty (one id, the end id); null ids are
kept; rows that repeat are packed as often as they occur; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER, document_ids, encoder, pieces_of

WIDTH = 2048
ROWS = 512
PAD = 0
SCHEMA = ("block long, block_start long, row int, n_ids int, ids binary, positions binary, cu_seqlens array<int>, "
          "doc_ids array<long>, starts array<long>")


class RoomTree:
    """Segment tree over room 0..width: which amounts of free room some row has."""

    def __init__(self, width: int):
        self.base = 1 << width.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.base
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the smallest room of at least ``need``, removed from the tree: (room, row)."""
        node = need + self.base
        while not self.count[node]:
            while node & 1:                   # a right child: nothing further right below this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.base:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.base
        row = self.rows[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows as lists of indices into ``lengths`` (each 1 to ``width``)."""
    tree, rows = RoomTree(width), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found = (width, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows


def _block(row_id: int, pieces: list[tuple], width: int, dtype: str) -> pa.RecordBatch:
    """``pieces`` (doc_id, start, ids) packed into the rows of one matrix."""
    rows = best_fit_decreasing([len(p[2]) for p in pieces], width)
    ids = np.full((len(rows), width), PAD, dtype)
    positions = np.zeros((len(rows), width), dtype if width <= 0xFFFF else "<u4")
    segments, docs, starts = [], [], []
    for r, members in enumerate(rows):
        cuts = [0]
        for i in members:
            part = pieces[i][2]
            ids[r, cuts[-1]:cuts[-1] + len(part)] = part
            positions[r, cuts[-1]:cuts[-1] + len(part)] = np.arange(len(part))
            cuts.append(cuts[-1] + len(part))
        segments.append(cuts)
        docs.append([pieces[i][0] for i in members])
        starts.append([pieces[i][1] for i in members])
    n = len(rows)
    return pa.record_batch(
        [pa.array([row_id] * n, pa.int64()), pa.array([pieces[0][1]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([c[-1] for c in segments], pa.int32()),
         pa.array([r.tobytes() for r in ids], pa.binary()), pa.array([r.tobytes() for r in positions], pa.binary()),
         pa.array(segments, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))],
        names=["block", "block_start", "row", "n_ids", "ids", "positions", "cu_seqlens", "doc_ids", "starts"])


def token_matrices(docs: DataFrame, width: int = WIDTH, rows: int = ROWS, tokenizer: str = TOKENIZER, wide: bool = False,
                   id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed matrices of all ``docs``; entries are 16 bits, or 32 with ``wide`` (for vocabularies over 65,536 ids)."""
    narrow = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text).cast("string").alias("text"))
    dtype = "<u4" if wide else "<u2"

    def run(batches):
        encode = encoder(tokenizer)
        first, held, size = None, [], 0
        for b in batches:
            for row, doc, t in zip(*(c.to_pylist() for c in b.columns)):
                ids = document_ids(encode, t)
                if not wide and ids.max() > 0xFFFF:
                    raise ValueError("ids need 32 bits: call with wide=True")
                for start, n in pieces_of(len(ids), width):
                    first = first if held else row
                    held.append((doc, start, ids[start:start + n].astype(dtype)))
                    size += n
                    if size >= rows * width:
                        yield _block(first, held, width, dtype)
                        held, size = [], 0
        if held:
            yield _block(first, held, width, dtype)

    return narrow.mapInArrow(run, SCHEMA)
