"""Suffix-array dedup over sampled suffixes: bytes covered by a repeated ``LENGTH``-byte string are removed.

A full suffix array writes every suffix's key, many times the corpus.  Here a
window of ``LENGTH`` bytes picks the suffix at its smallest ``LEAD``-byte
string (hashed, leftmost), so equal windows pick the same suffix at the same
distance, and only about one suffix in 70 is sorted:

1. One scan lists, per picked suffix, its leading token (hash of ``LEAD``
   bytes) and its stretch: the run of window starts that picked it and a hash of
   all bytes those windows cover.
2. Sampled splitters range-partition the suffixes by leading token, then by the
   rest of the stretch, then by place, so that a token that a third of the
   corpus shares is split too.  Buckets are sorted word by word of the key
   (external sort) and neighbours compared; the first and last suffix of each
   bucket, two rows, are compared across boundaries.  A stretch that occurs
   twice is repeated as a whole; a token that occurs once repeats nowhere.
3. Where stretches share a token but differ somewhere (as at the edges of a
   repeated passage), a row or two of each distinct stretch are refined: the run
   is cut into blocks of ``BLOCK`` starts, aligned to the distance from the
   picked suffix, whose token is all the bytes that the block's windows share
   and whose rest is all that they cover, and the blocks go through the same
   sort.  Blocks that still share a token and differ are refined to single
   window starts, where token and rest are the window itself.
4. Repeated starts are merged per document and cut out of its text.

Equality of byte strings is judged on a hash of 128 bits of all of them (``rest`` and
``more``), beside that of the leading bytes.  Texts are taken whole;
a long text is scanned in overlapping pieces, so memory doesn't follow its
length times a constant of numpy arrays.

Defined cases: null text counts as empty; shorter texts than ``LENGTH`` lose
nothing; rows that repeat lose everything that is long enough (each copy
"starts anywhere else"); a null id is kept as null; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, files_for, fresh, numbered, partitions, raw, stage, unstage

LENGTH = 200
LEAD = 64
BLOCK = 16
_PIECE = 1 << 19          # window starts scanned at once
_RUNS = 1 << 12           # runs refined at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COLS = ["token", "rest", "more", "row_id", "start", "starts", "back"]
_SCHEMA = "token long, rest long, more long, row_id long, start long, starts int, back int"
_BITS = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def leading(buf: bytes, lead: int) -> np.ndarray:
    """Hash of the ``lead`` (8 or more) bytes from each position."""
    n = len(buf) - 7
    h = np.empty(n, np.uint64)
    for k in range(8):
        h[k::8] = np.frombuffer(buf, "<u8", (n - k + 7) // 8, k)
    h, size = _mix(h), 8
    while size < lead:
        step = min(size, lead - size)
        h = _mix(h[:-step] * _ODD + h[step:])
        size += step
    return h


def picked(buf: bytes, starts: np.ndarray, ends: np.ndarray, length: int, lead: int):
    """Runs of window starts that pick one suffix: (first start, starts, suffix, hashes of leading bytes).

    ``starts`` and ``ends`` bound the pieces that ``buf`` joins; no window crosses them.
    """
    h = leading(buf, lead)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - lead + 1, 1
    while reach * 2 <= width:
        key, reach = np.minimum(key[:-reach], key[reach:]), reach * 2
    if reach < width:
        key = np.minimum(key[:len(key) - (width - reach)], key[width - reach:])
    pick = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long = ends - starts >= length
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge)[:len(pick)] > 0)
    first = np.zeros(len(buf) + 1, bool)
    first[starts] = True
    new = np.ones(len(at), bool)
    new[1:] = (pick[at[1:]] != pick[at[:-1]]) | (np.diff(at) > 1) | first[at[1:]]
    runs = np.flatnonzero(new)
    return at[runs], np.diff(np.append(runs, len(at))), pick[at[runs]], h


def _suffixes(rows: list[int], texts: list[bytes], length: int, lead: int):
    """Record batches of the picked suffixes of whole texts; ``back`` is the way from a run's first start to its suffix."""
    def flush(held):
        buf = b"".join(p for _, _, p in held) + bytes(8)
        ends = np.cumsum([len(p) for _, _, p in held])
        begin = ends - [len(p) for _, _, p in held]
        s, n, suffix, h = picked(buf, begin, ends, length, lead)
        digest = xxhash.xxh3_128_digest
        whole = b"".join([digest(buf[a:b]) for a, b in zip(s.tolist(), (s + n + length - 1).tolist())])
        rest, more = np.frombuffer(whole, ">u8").reshape(-1, 2).astype(np.uint64).T
        rest = rest ^ (suffix - s).astype(np.uint64) * _ODD
        piece = np.searchsorted(begin, s, side="right") - 1
        row = np.array([r for r, _, _ in held], np.int64)[piece]
        off = np.array([o for _, o, _ in held], np.int64)[piece]
        return pa.record_batch([pa.array(x) for x in (h[suffix].view(np.int64), rest.view(np.int64), np.ascontiguousarray(more).view(np.int64), row, s - begin[piece] + off,
                                                      n.astype(np.int32), (suffix - s).astype(np.int32))], names=_COLS)

    held, size = [], 0
    for row, text in zip(rows, texts):
        for at in range(0, len(text) - length + 1, _PIECE):
            held.append((row, at, text[at:at + _PIECE + length - 1]))
            size += len(held[-1][2])
            if size >= _PIECE:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def sorted_repeats(suffixes: DataFrame, label: str, files: int, last: bool = False) -> DataFrame:
    """Sort suffixes by token, rest and place and compare neighbours.

    Returns them without ``rest`` and with two marks: ``again``, token and rest occur elsewhere;
    ``differs``, the row stands beside one with the same token and another rest, which every distinct
    rest of such a token does with a row or two.  Rows with neither mark (with ``last``, those that
    don't occur again) are left out.
    """
    keys = _COLS[:5]
    ordered = suffixes.select(_COLS).repartitionByRange(partitions(suffixes.sparkSession), *keys).sortWithinPartitions(*keys)

    def compare(batches):
        """Verdicts; a bucket's first and last row are passed on as its edges."""
        held, again_held, differs_held = None, False, False     # the last row so far and its marks towards the rows before
        first = True

        def out(rows, again, differs, edge):
            return pa.record_batch([*map(pa.array, rows), pa.array(again), pa.array(differs),
                                    pa.array(np.full(len(again), edge))], names=[*_COLS, "again", "differs", "edge"])

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(c).to_numpy() for c in _COLS]
            rows = new if held is None else [np.concatenate((h, n)) for h, n in zip(held, new)]
            token = rows[0][1:] == rows[0][:-1]
            same = token & (rows[1][1:] == rows[1][:-1]) & (rows[2][1:] == rows[2][:-1])
            again = np.concatenate(([again_held], same))          # towards the row before
            differs = np.concatenate(([differs_held], token & ~same))
            held, again_held, differs_held = [r[-1:].copy() for r in rows], bool(again[-1]), bool(differs[-1])
            again, differs = again[:-1] | same, differs[:-1] | (token & ~same)
            lo = 0
            if first and len(again):
                yield out([r[:1] for r in rows], again[:1], differs[:1], True)
                first, lo = False, 1
            keep = np.flatnonzero(again[lo:] if last else again[lo:] | differs[lo:]) + lo
            if len(keep):
                yield out([r[keep] for r in rows], again[keep], differs[keep], False)
        if held is not None:
            yield out(held, np.array([again_held]), np.array([differs_held]), True)

    marked = stage(ordered.mapInArrow(compare, _SCHEMA + ", again boolean, differs boolean, edge boolean"), label, files)
    # two rows per bucket: equal keys of different buckets meet in a small aggregate
    edges = marked.where("edge")
    tokens = edges.groupBy("token").agg(F.count(F.lit(1)).alias("n_token"))
    wholes = edges.groupBy("token", "rest", "more").agg(F.count(F.lit(1)).alias("n_rest"))
    settled = (edges.join(tokens, "token").join(wholes, ["token", "rest", "more"])
               .withColumn("again", F.col("again") | (F.col("n_rest") > 1))
               .withColumn("differs", F.col("differs") | (F.col("n_token") > F.col("n_rest"))))
    names = ["token", "row_id", "start", "starts", "back", "again", "differs"]
    return marked.where(~F.col("edge")).select(names).union(settled.where("again or differs").select(names))


def blocks_of(text: bytes, token: int, start: int, starts: int, back: int, length: int, size: int):
    """(token, rest, more, start, starts, back) of the blocks of a run, aligned to the distance from its suffix."""
    digest = xxhash.xxh3_128_intdigest
    suffix, at, end = start + back, start, start + starts
    while at < end:
        number = (suffix - at) // size
        least = number * size                                 # distances least .. least + size - 1
        upto = min(end - 1, suffix - least)
        whole = digest(text[at:upto + length])
        shared = whole if size == 1 else digest(text[suffix - least:suffix - least - size + 1 + length])
        yield ((shared ^ (token + number) * 0x9E3779B97F4A7C15) & _BITS,
               (whole >> 64 ^ ((suffix - at) << 32 | upto - at) * 0x9E3779B97F4A7C15) & _BITS, whole & _BITS, at, upto - at + 1, suffix - at)
        at = upto + 1


def _refined(runs: DataFrame, texts: DataFrame, length: int, size: int) -> DataFrame:
    """The runs that are left, in blocks of ``size`` starts."""
    names = ["token", "start", "starts", "back"]
    joined = runs.groupBy("row_id").agg(F.collect_list(F.struct(*names)).alias("runs")).join(texts, "row_id")

    def run(batches):
        for b in batches:
            for row, text, own in zip(b.column("row_id").to_pylist(), raw(b.column("text")), b.column("runs")):
                values = [own.values.field(c).to_numpy() for c in names]
                for at in range(0, len(values[0]), _RUNS):     # a long text's runs in parts
                    parts = [k for r in zip(*(v[at:at + _RUNS].tolist() for v in values)) for k in blocks_of(text, *r, length, size)]
                    token, rest, more, start, starts, back = zip(*parts)
                    yield pa.record_batch([pa.array(np.array(token, np.uint64).view(np.int64)),
                                           pa.array(np.array(rest, np.uint64).view(np.int64)), pa.array(np.array(more, np.uint64).view(np.int64)),
                                           pa.array(np.full(len(parts), row)),
                                           pa.array(start, pa.int64()), pa.array(starts, pa.int32()), pa.array(back, pa.int32())],
                                          names=_COLS)

    return joined.mapInArrow(run, _SCHEMA)


def repeated_runs(texts: DataFrame, length: int = LENGTH, lead: int = LEAD, block: int = BLOCK) -> DataFrame:
    """(row_id, text: binary) to (row_id, start, starts): runs of starts of strings that occur elsewhere."""
    def scan(batches):
        for b in batches:
            yield from _suffixes(b.column("row_id").to_pylist(), raw(b.column("text")), length, lead)

    names, files = ["row_id", "start", "starts"], files_for(texts)
    suffixes = stage(texts.select("row_id", "text").mapInArrow(scan, _SCHEMA), "suffixes", files)
    marked = sorted_repeats(suffixes, "suffix-stretches", files)
    found = marked.where("again").select(names)
    for size in (block, 1):
        left = marked.where("differs")
        unstage(suffixes)
        suffixes = stage(_refined(left, texts, length, size), f"suffixes-{size}", files)
        marked = sorted_repeats(suffixes, f"suffix-blocks-{size}", files, last=size == 1)
        found = found.union(marked.where("again").select(names))
    unstage(suffixes)
    return found


def merge(start: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal (from, to) byte spans covered by the windows that begin in the runs."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    a = start[order]
    reach = np.maximum.accumulate(a + starts[order] - 1 + length)
    new = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
    return list(zip(a[new].tolist(), reach[np.append(new[1:], len(a)) - 1].tolist()))


def _spans(column: pa.Array, length: int):
    """The merged spans of every row of a list column of runs; null lists have none."""
    for own in column:
        if own.is_valid:
            yield merge(own.values.field("start").to_numpy(), own.values.field("starts").to_numpy(), length)
        else:
            yield []


def _with_runs(docs: DataFrame, text: str, row: str, runs_name: str, length: int, lead: int) -> DataFrame:
    rows = numbered(docs, row)
    texts = rows.select(F.col(row).alias("row_id"), F.col(text).cast("binary").alias("text"))
    runs = repeated_runs(texts, length, lead).groupBy("row_id").agg(
        F.collect_list(F.struct("start", "starts")).alias(runs_name)).withColumnRenamed("row_id", row)
    return rows.join(runs, row, "left")


def op3(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    joined = _with_runs(narrow, "text", "row_id", "runs", length, lead)

    def run(batches):
        for b in batches:
            sizes, removed, spans, digests = [], [], [], []
            for text, cut in zip(raw(b.column("text")), _spans(b.column("runs"), length)):
                digest, at = hashlib.sha256(), 0
                for a, e in cut:
                    digest.update(text[at:a])
                    at = e
                digest.update(text[at:])
                sizes.append(len(text))
                removed.append(sum(e - a for a, e in cut))
                spans.append(len(cut))
                digests.append(digest.hexdigest())
            yield pa.record_batch([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)],
                                   pa.array(digests, pa.string())],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return compact(joined.select("doc_id", "text", "runs").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), files_for(docs))


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` (UTF-8) without the spans; a character that lies only partly in a span stays."""
    out, at = [], 0
    for a, b in spans:
        while a < b and a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def drop_repeats(docs: DataFrame, text: str = "text", chars: str | None = "n_chars", length: int = LENGTH,
                 lead: int = LEAD) -> DataFrame:
    """``docs`` with the repeated spans cut out of the text.

    ``chars``, where the table has it, is set to the new number of characters of changed texts.
    """
    row, runs_name = fresh(docs, "row"), fresh(docs, "runs")
    joined = _with_runs(docs, text, row, runs_name, length, lead)
    columns = docs.columns
    schema = joined.select(columns).schema

    def run(batches):
        for b in batches:
            cuts = list(_spans(b.column(runs_name), length))
            at = b.schema.get_field_index(text)
            if any(cuts):
                old = b.column(at).to_pylist()
                new = [t if not r else cut_text(t.encode(), r).decode("utf-8", "replace") for t, r in zip(old, cuts)]
                b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
                if chars in columns:
                    c = b.schema.get_field_index(chars)
                    kind = b.schema.field(c).type
                    size = [len(t) if r else n for t, r, n in zip(new, cuts, b.column(c).to_pylist())]
                    b = b.set_column(c, b.schema.field(c), pa.array(size, kind))
            yield b.select(columns)

    return compact(joined.select(*columns, runs_name).mapInArrow(run, schema), files_for(docs))
