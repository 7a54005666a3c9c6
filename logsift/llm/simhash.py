"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: ASCII lower case, words between white space, shingles of three
words joined by one space (a shorter text is one shingle, an empty or null text
has fingerprint 0), XXH64 with seed 42; a bit is set if it is set in over half
of the shingles' hashes, repeats included.

Two fingerprints link at ``RADIUS`` or fewer differing bits.  64 bits are cut
into ``RADIUS + 2`` parts; a linked pair agrees in at least two of them, so
every pair of parts makes a bucket key and each linked pair shares a bucket.
Only distinct fingerprints are compared: copies collapse in a partial
aggregate.  A bucket of more than ``CHUNK`` fingerprints is dealt to pairs of
chunks, so its rows spread over tasks and every pair still meets.

Inside a bucket the bits stand vertically: word w of plane p holds bit p of
fingerprints 64w to 64w+63.  A query adds its XOR with each plane to bitwise
counters (carry-save), which updates 64 distances per word operation; after
every 8 planes, words whose 64 distances have all passed the radius are
dropped.  Links are reported as a forest (member, root), never as all pairs.

Defined cases: rows that repeat have the same fingerprint and component; a null
id orders last and is reported as null only if its component has no other; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, files_for, fresh, numbered, partitions, raw, stage
from .components import components

SHINGLE = 3
RADIUS = 2
CHUNK = 4096
_LAST = (1 << 63) - 1
_SLICE = 1 << 16          # hashes whose bits are counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        part = hashes[at:at + _SLICE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 row: str | None = None) -> DataFrame:
    """row_id (``row`` of ``docs``, if named), doc_id, fp (the 64 bits as a long) of every row."""
    narrow = docs.select((F.monotonically_increasing_id() if row is None else F.col(row)).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in raw(b.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("row_id"), b.column("doc_id"), pa.array(fps)], names=["row_id", "doc_id", "fp"])

    return narrow.mapInArrow(run, "row_id long, doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w in plane p is bit p of fingerprint 64w + i."""
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, n: int, queries: np.ndarray, radius: int, use: np.ndarray) -> np.ndarray:
    """Boolean (queries, n): at most ``radius`` of the planes ``use`` differ."""
    words = planes.shape[1]
    alive = np.arange(words)
    width = (radius + 1).bit_length()
    counters = [np.zeros((len(queries), words), np.uint64) for _ in range(width)]
    over = np.zeros((len(queries), words), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i, p in enumerate(use):
        flip = np.where(queries >> np.uint64(p) & np.uint64(1), full, np.uint64(0))[:, None]
        carry = planes[p, alive][None, :] ^ flip
        for c in counters:                       # carry-save addition of one bit to 64 counters per word
            carry, c[...] = c & carry, c ^ carry
        over |= carry
        if i % 8 == 7 or i + 1 == len(use):
            over |= _above(counters, radius)
            left = ~(over == full).all(axis=0)   # abandon words that no query can match any more
            if not left.all():
                alive, over, counters = alive[left], over[:, left], [c[:, left] for c in counters]
            if not len(alive):
                break
    out = np.zeros((len(queries), words), np.uint64)
    out[:, alive] = ~over
    return np.unpackbits(out.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Mask of the lanes whose counter is over ``radius``, by bitwise comparison from the top bit."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def forest(fps: np.ndarray, radius: int, use: np.ndarray, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints as (member, root) within each linked set."""
    n = len(fps)
    planes = bit_planes(fps)
    parent = np.arange(n)
    for at in range(0, n, batch):
        near = within(planes, n, fps[at:at + batch], radius, use)
        for row in np.flatnonzero(near.sum(1) > 1):
            tops = np.flatnonzero(near[row])
            while (up := parent[tops]).tobytes() != tops.tobytes():
                tops = up
            tops = np.unique(tops)
            parent[tops] = tops[0]
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    member = np.flatnonzero(parent != np.arange(n))
    return fps[member], fps[parent[member]]


def _parts(radius: int) -> list[tuple[int, int]]:
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Distinct ``fp`` to edges (a, b) whose components are those of all pairs within ``radius``."""
    parts = _parts(radius)
    combos = list(itertools.combinations(range(len(parts)), 2))
    masks = [sum(((1 << hi - lo) - 1) << lo for lo, hi in (parts[i] for i in c)) for c in combos]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits"))
                                                 for i, m in enumerate(signed)])).alias("k")).select("k.*", "fp")
    sizes = keyed.groupBy("combo", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = (keyed.join(sizes, ["combo", "bits"])
             .withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
             .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
             .select("combo", "bits", "mine", "fp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
             .select("combo", "bits", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp"))
    key = ["combo", "bits", "lo", "hi"]
    ordered = dealt.repartition(partitions(fps.sparkSession), *key).sortWithinPartitions(*key)
    unequal = [np.array([p for i, (lo, hi) in enumerate(parts) if i not in c for p in range(lo, hi)]) for c in combos]

    def run(batches):
        now, held = None, []

        def links(key, held):
            a, b = forest(np.unique(np.concatenate(held)).view(np.uint64), radius, unequal[key[0]])
            return pa.record_batch([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(4)]
            values = b.column("fp").to_numpy()
            new = np.ones(len(values), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            starts = np.flatnonzero(new)
            for s, e in zip(starts, [*starts[1:], len(values)]):
                k = tuple(int(c[s]) for c in cols)
                if k != now:
                    if now and sum(map(len, held)) > 1:
                        yield links(now, held)
                    now, held = k, []
                held.append(values[s:e])
        if now and sum(map(len, held)) > 1:
            yield links(now, held)

    return ordered.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS,
                shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """One row per input row: row_id (``row`` of ``docs``, if named), doc_id, fp, component_id and ``first_row``, the row that stands for its component."""
    rows = stage(fingerprints(docs, id_col, text, shingle, row), "simhash", files_for(docs))
    few = files_for(rows, 1)
    order = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.col("row_id").alias("row"))
    fps = rows.groupBy("fp").agg(F.min(order).alias("first"))
    roots = components(link_fingerprints(fps.select("fp"), radius), few)
    rooted = fps.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left")
    rooted = stage(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "simhash-roots", few)
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    answer = rooted.join(best, "root").select("fp", F.when(F.col("best.id") != _LAST, F.col("best.id")).alias("component_id"),
                                              F.col("best.row").alias("first_row"))
    return rows.join(answer, "fp")


def op5(docs: DataFrame) -> DataFrame:
    return compact(near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"),
                   files_for(docs))


def keep_first(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the smallest id of each linked group."""
    row = fresh(docs, "row")
    rows = numbered(docs, row)
    kept = near_groups(rows, id_col, text, row=row).where("row_id = first_row").select(F.col("row_id").alias(row))
    return compact(rows.join(kept, row, "left_semi").drop(row), files_for(docs))
