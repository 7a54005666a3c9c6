"""Cross-tokenizer alignment by diagonal run skipping.

A text is encoded by a byte-level BPE file (A, of space + text) and by a
SentencePiece model (B, which puts the space itself).  Both cover the same
bytes; where tokens of both end at one byte, a group ends, and those two tokens
are linked.

* Tasks encode slices of whole texts and lay the texts' end offsets on end.
  ``joint_ends`` compares the two end arrays at the current shift (the diagonal),
  in blocks that double while all ends of a block agree, so stretches of one-to-one
  tokens are jumped; at the first difference the irregular group is resolved by
  advancing the side that is behind, which updates the shift.  Lanes (texts, and
  parts of long ones that begin at a joint end) take these steps side by side.
* Tasks add up the links of id pairs before anything is shuffled, and texts are
  staged with their distinct pairs only.  The table of pair counts is broadcast
  in parts of at most ``PAIRS`` rows, one pass over the staged rows for each part
  (one in all unless the corpus has more pairs).

Defined cases: null and empty texts, and those whose tokens don't spell space +
text (a text with U+2581), have no tokens: zeros, and '' for the digest; rows that
repeat count again; a null id is kept; only the named columns are read, so other
columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import files_for, per_worker, stage
from .tokens import TOKENIZER, load_encoder, token_bytes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
PAIRS = 1 << 20           # rows of a broadcast part of the pair table: 24 MB
LANE = 256                # tokens of a lane, about
SLICE = 4 << 20           # bytes of text taken at once
_HELD = 1 << 20           # pairs a task adds up before it sends them


class Tokenizers:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, path: str, model: str):
        import sentencepiece

        self.a = load_encoder(path, marks=False)
        self.a_bytes = token_bytes(path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.b_bytes = [bytes((int(p[3:5], 16),)) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)

    def encode(self, texts: list[str]):
        """The ids of A and of B of every text, none where they don't spell space + text."""
        out_a, out_b = [], []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            if not text:
                a, b = [], []
            else:
                whole = " " + text
                a, plain = self.a(whole), whole.encode()
                if (b"".join(map(self.b_bytes.__getitem__, b)) != plain or b"".join(map(self.a_bytes.__getitem__, a)) != plain):
                    a, b = [], []
            out_a.append(a)
            out_b.append(b)
        return out_a, out_b


def _resolve(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From places (i, j) on, the next places whose ends agree: the side that is behind advances."""
    i, j = i.copy(), j.copy()
    left = np.arange(len(i))
    while len(left):
        x, y = a[i[left]], b[j[left]]
        i[left] += x < y
        j[left] += x > y
        left = left[x != y]
    return i, j


def lanes(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, lane: int):
    """Where lanes begin in a and b, sorted: every text's first token, and in long texts the token after a joint end."""
    count = np.diff(np.append(first_a, len(a)))
    more = np.maximum(count // lane - 1, 0)
    k = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
    i = np.repeat(first_a, more) + k * lane
    i, j = _resolve(a, b, i, np.searchsorted(b, a[i]))
    i, j = np.concatenate((first_a, i + 1)), np.concatenate((first_b, j + 1))
    i, at = np.unique(i, return_index=True)
    j = j[at]
    inside = i < len(a)
    return i[inside], j[inside]


def joint_ends(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, lane: int = LANE):
    """Which tokens of a and b end a group: marks of both, with equally many in the same order.

    ``a`` and ``b`` are the increasing end offsets of all texts on end; ``first_a`` and ``first_b`` are
    the first tokens of the texts, which have tokens of both kinds that end at the text's last byte.
    """
    mark_a, mark_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if not len(a):
        return mark_a, mark_b
    i, j = lanes(a, b, first_a, first_b, lane)
    stop_a, stop_b = np.append(i[1:], len(a)), np.append(j[1:], len(b))
    width = np.ones(len(i), np.int64)
    while len(i):
        # probe a block on the diagonal; blocks end where either side's lane ends
        w = np.minimum(width, np.minimum(stop_a - i, stop_b - j))
        begin = np.cumsum(w) - w
        step = np.arange(int(w.sum())) - np.repeat(begin, w)
        at_a, at_b = np.repeat(i, w) + step, np.repeat(j, w) + step
        same = a[at_a] == b[at_b]
        run = np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, step), begin)
        run = np.minimum(run, w)
        on = step < np.repeat(run, w)
        mark_a[at_a[on]] = True
        mark_b[at_b[on]] = True
        i, j = i + run, j + run
        broken = run < w
        width = np.where(broken, 1, width * 2)
        # a block that broke: its irregular group, after which both sides stand behind a joint end again
        odd = np.flatnonzero(broken)
        if len(odd):
            x, y = _resolve(a, b, i[odd], j[odd])
            mark_a[x] = True
            mark_b[y] = True
            i[odd], j[odd] = x + 1, y + 1
        more = i < stop_a
        if not more.all():
            i, j, stop_a, stop_b, width = i[more], j[more], stop_a[more], stop_b[more], width[more]
    return mark_a, mark_b


class Aligned:
    """A slice of texts with their tokens and groups, all on end; ``cut_*`` has the texts' bounds."""

    def __init__(self, texts: list[str], both: Tokenizers):
        ids_a, ids_b = both.encode(texts)
        n_a, n_b = np.array(list(map(len, ids_a)), np.int64), np.array(list(map(len, ids_b)), np.int64)
        self.a = np.fromiter((i for ids in ids_a for i in ids), np.int32, int(n_a.sum()))
        self.b = np.fromiter((i for ids in ids_b for i in ids), np.int32, int(n_b.sum()))
        self.cut_a, self.cut_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        there = n_a > 0
        self.mark_a, self.mark_b = joint_ends(np.cumsum(both.a_size[self.a]), np.cumsum(both.b_size[self.b]),
                                              self.cut_a[:-1][there], self.cut_b[:-1][there])
        self.n_a, self.n_b = n_a, n_b
        self.end_a, self.end_b = np.flatnonzero(self.mark_a) + 1, np.flatnonzero(self.mark_b) + 1
        self.cut_groups = np.searchsorted(self.end_a, self.cut_a, side="right")
        self.n_groups = np.diff(self.cut_groups)

    def pairs(self):
        """Per text its distinct linked id pairs and how often: bounds, a, b, n."""
        a, b = self.a[self.mark_a].astype(np.int64), self.b[self.mark_b]
        keys, code = np.unique(a << 32 | b, return_inverse=True)
        text = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        each, n = np.unique(text << 32 | code, return_counts=True)
        cut = np.searchsorted(each, np.arange(len(self.n_groups) + 1) << 32)
        keys = keys[each & 0xFFFFFFFF]
        return cut, (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), n.astype(np.int64)

    def digests(self) -> list[str]:
        """SHA-256 of the groups written as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        total = len(self.a) + len(self.b)
        group_a = np.cumsum(self.mark_a) - self.mark_a
        group_b = np.cumsum(self.mark_b) - self.mark_b
        before_b = np.append(0, self.end_b[:-1]) if len(self.end_b) else self.end_b
        at_a = np.arange(len(self.a)) + before_b[group_a]
        at_b = np.arange(len(self.b)) + self.end_a[group_b]
        ids, after = np.zeros(total, np.int64), np.zeros(total, np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        after[at_a], after[at_b] = np.where(self.mark_a, ord("|"), ord(",")), np.where(self.mark_b, ord(";"), ord(","))
        width = len(str(int(ids.max()))) if total else 1
        powers = 10 ** np.arange(width - 1, -1, -1)
        written = np.empty((total, width + 1), np.uint8)
        for k, p in enumerate(powers.tolist()):
            written[:, k] = ids // p % 10 + 48
        written[:, width] = after
        keep = np.ones((total, width + 1), bool)
        keep[:, :width - 1] = ids[:, None] >= powers[:-1]
        flat = written[keep].tobytes()
        ends = np.append(0, np.cumsum(keep.sum(axis=1)))[self.cut_a + self.cut_b]
        return [hashlib.sha256(flat[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(ends.tolist(), ends[1:].tolist())]


def _lists(cut: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values))


def _slices(b: pa.RecordBatch, size: int = SLICE):
    """Parts of a batch of about ``size`` bytes of text, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < b.num_rows:
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), size)) + at)
        yield b.slice(at, upto - at)
        at = upto


def _read(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = TOKENIZER, model: str = MODEL) -> DataFrame:
    """doc_id, a_ids, b_ids and for every group how many tokens of the text end with it: a_ends, b_ends."""
    def run(batches):
        both = per_worker(f"tokenizers {path} {model}", lambda: Tokenizers(path, model))
        for whole in batches:
            for b in _slices(whole):
                x = Aligned(b.column("text").to_pylist(), both)
                own_a, own_b = np.repeat(x.cut_a[:-1], x.n_groups), np.repeat(x.cut_b[:-1], x.n_groups)
                yield pa.record_batch([b.column("doc_id"), _lists(x.cut_a, x.a), _lists(x.cut_b, x.b),
                                       _lists(x.cut_groups, (x.end_a - own_a).astype(np.int32)),
                                       _lists(x.cut_groups, (x.end_b - own_b).astype(np.int32))],
                                      names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return _read(docs, id_col, text).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def linked_texts(docs: DataFrame, id_col: str, text: str, path: str, model: str) -> DataFrame:
    """Per row its counts, digest and distinct linked pairs (a, b, n)."""
    def run(batches):
        both = per_worker(f"tokenizers {path} {model}", lambda: Tokenizers(path, model))
        for whole in batches:
            for b in _slices(whole):
                x = Aligned(b.column("text").to_pylist(), both)
                cut, pair_a, pair_b, n = x.pairs()
                yield pa.record_batch([b.column("doc_id"), pa.array(x.n_a), pa.array(x.n_b), pa.array(x.n_groups),
                                       pa.array(x.digests(), pa.string()), _lists(cut, pair_a), _lists(cut, pair_b), _lists(cut, n)],
                                      names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "n"])

    return _read(docs, id_col, text).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, n array<long>")


def _keys(b: pa.RecordBatch) -> np.ndarray:
    a, c = (b.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "b"))
    return a << 32 | c


def pair_counts(texts: DataFrame) -> DataFrame:
    """a, b, n (links of the pair over all texts) and best (the highest of its b)."""
    def run(batches):
        held, counts, size = [], [], 0

        def out(keys, n):
            return pa.record_batch([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)],
                                   names=["a", "b", "n"])

        def added():
            keys, code = np.unique(np.concatenate(held), return_inverse=True)
            return keys, np.bincount(code, np.concatenate(counts), len(keys)).astype(np.int64)

        for b in batches:
            keys = _keys(b)
            held.append(keys)
            counts.append(b.column("n").flatten().to_numpy(zero_copy_only=False))
            size += len(keys)
            if size > 4 * _HELD:
                keys, n = added()
                if len(keys) > _HELD:
                    yield out(keys, n)
                    keys, n = keys[:0], n[:0]
                held, counts, size = [keys], [n], len(keys)
        if held:
            yield out(*added())

    pairs = texts.select("a", "b", "n").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def link_sums(texts: DataFrame, pairs: DataFrame, part_rows: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark, files = texts.sparkSession, files_for(texts)
    n_pairs = pairs.count()
    parts = max(1, -(-n_pairs // (part_rows - part_rows // 4)))        # parts by hash are not quite even
    texts = texts.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for part in range(parts):
        own = (pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part)).toArrow()
        keys = own["a"].to_numpy().astype(np.int64) << 32 | own["b"].to_numpy()
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[order], own["n"].to_numpy()[order], own["best"].to_numpy()[order]))

        def run(batches, shared=shared):
            table, counts, best = shared.value
            for b in batches:
                lists = b.column("a")
                offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                keys, n = _keys(b), b.column("n").flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
                found = table[at] == keys if len(table) else np.zeros(len(keys), bool)
                sums = []
                for name, value in (("n_best", best), ("count_sum", counts)):
                    each = np.where(found, value[at] * n, 0) if len(table) else np.zeros(len(keys), np.int64)
                    sums.append(b.column(name).to_numpy() + np.diff(np.append(0, np.cumsum(each))[offsets]))
                kept = [b.column(c) for c in b.schema.names if c not in ("n_best", "count_sum")]
                yield pa.record_batch([*kept, *map(pa.array, sums)], names=[*b.schema.names[:-2], "n_best", "count_sum"])

        texts = texts.mapInArrow(run, texts.schema)
        if part < parts - 1:
            texts = stage(texts, "linked-part", files)
    return texts.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def alignment_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = TOKENIZER, model: str = MODEL,
                    part_rows: int = PAIRS) -> DataFrame:
    """The digest of every row's alignment: counts of tokens, groups and links, sums of its links' corpus-wide counts.

    Ends increase, so a group has one link: its last A and its last B token.
    """
    texts = stage(linked_texts(docs, id_col, text, path, model), "linked", files_for(docs))
    pairs = stage(pair_counts(texts), "pairs", files_for(texts, 1))
    return link_sums(texts, pairs, part_rows)


def op11(docs: DataFrame) -> DataFrame:
    return alignment_links(docs)
