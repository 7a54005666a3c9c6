"""SentencePiece encoding and decoding over a relational lattice of pieces.

A text becomes words: a run of spaces with the characters up to the next one;
line feeds stand alone.  No piece (where U+2581 writes the space) reaches over
such an edge, so a text's ids are its words' ids in order.

Lattice (``lattice_ids``): a word's substrings of at most ``LONGEST`` characters
are exploded, equi-joined to the piece table and grouped by word again, which
keeps the word's partitioning and moves no edge; a fold with ``aggregate`` over
the word's edges gives its ids.  Two folds:

* ``viterbi``: best sum of scores up to every position, for unigram models;
* ``merges``: for BPE models, such as the one used here.  A BPE piece list isn't
  a distribution over paths, and Viterbi over its scores gives other ids than
  the model defines.  The fold takes the edges in score order; an edge whose two
  ends are token edges with exactly one token edge between them joins those two
  tokens.  Token edges are the bits of one long.

Texts (``encode_texts``): words are counted, the most frequent ones (at most
``TABLE_WORDS``, by a count threshold) go through the lattice, and the table of
their ids, bounded by that number, is broadcast to one pass over the texts.
Other words are folded in that pass by the same rule (``fold_words``, long ones
``fold_long`` in n log n), since most of them occur once and a shuffle of all
their places would outweigh the texts.

Characters without a piece become byte pieces.  Decoding puts pieces and bytes
together and drops the leading space.

Defined cases: null and empty texts have no ids; rows that repeat are encoded
alike; null ids of rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import re
import uuid
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import files_for, per_worker, stage

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
TABLE_WORDS = 1 << 17
LONGEST = 16              # characters of a piece, at most; checked against the model
_BITS = 60                # characters of a word whose token edges fit one long
_CACHE = 1 << 17          # other words a task remembers
_LONG = 200               # characters of a word from which on it is folded by itself, with a heap
_SLICE = 2 << 20          # bytes of text encoded at once
_SPACE_BYTES = SPACE.encode()
_WORD = re.compile(" *[^ \n]+| +|\n")


@dataclass
class Pieces:
    """A model's ordinary pieces with their ids and scores, and its byte pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    texts: list[str]          # by id; control pieces are empty
    heads: frozenset[str] = frozenset()      # beginnings of pieces, of two characters or more
    is_byte: frozenset[int] = frozenset()

    def __post_init__(self):
        self.is_byte = frozenset(self.byte_ids)
        self.heads = frozenset(p[:i] for p in self.ids for i in range(2, len(p) + 1))

    def spell(self, token: str) -> list[int]:
        found = self.ids.get(token)
        return [self.byte_ids[b] for b in token.encode()] if found is None else [found]


def load_pieces(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    texts = ["" if model.is_control(i) else model.id_to_piece(i) for i in every]
    return Pieces({texts[i]: i for i in plain}, {texts[i]: model.get_score(i) for i in plain}, byte_ids, texts)


def words_of(text: str | None) -> list[str]:
    """The words of a text and the space put before it; put together, they are that text."""
    return _WORD.findall(" " + text.replace(SPACE, " ")) if text else []


def fold_word(word: str, pieces: Pieces, viterbi: bool = False) -> list[int]:
    """The ids of one word, by the rule of the relational fold."""
    word = word.replace(" ", SPACE)
    n, scores, heads = len(word), pieces.scores, pieces.heads
    edges = []
    for s in range(n - 1):
        for e in range(s + 2, min(n, s + LONGEST) + 1):
            part = word[s:e]
            if part not in heads:
                break
            if part in scores:
                edges.append((-scores[part], s, e))
    if viterbi:
        floor = min(scores.values()) - 10
        best = [(0.0, 0)]
        for e in range(1, n + 1):
            into = [(best[e - 1][0] + scores.get(word[e - 1], floor), e - 1)]
            best.append(max(into + [(best[s][0] - cost, s) for cost, s, to in edges if to == e]))
        cuts = [n]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        cuts.reverse()
    else:
        mask = (1 << n + 1) - 1
        for _, s, e in sorted(edges):
            if mask >> s & 1 and mask >> e & 1:
                inner = mask >> s + 1 & (1 << e - s - 1) - 1
                if inner and not inner & inner - 1:
                    mask ^= inner << s + 1
        cuts = [i for i in range(n + 1) if mask >> i & 1]
    return [i for a, b in zip(cuts, cuts[1:]) for i in pieces.spell(word[a:b])]


class Joins:
    """The relation (left piece, right piece) -> the piece that they spell together."""

    def __init__(self, pieces: Pieces):
        pairs = sorted((pieces.ids[p[:i]] << 20 | pieces.ids[p[i:]], joined) for p, joined in pieces.ids.items()
                       for i in range(1, len(p)) if p[:i] in pieces.ids and p[i:] in pieces.ids)
        self.keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.joined = np.array([j for _, j in pairs] + [-1], np.int64)
        self.cost = np.full(len(pieces.texts) + 1, np.inf)          # the last entry is for "no piece", -1
        self.cost[list(pieces.ids.values())] = [-pieces.scores[p] for p in pieces.ids]
        # characters: the piece of one, or a negative number that tells which character has none
        self.single = -2 - np.arange(0x110000, dtype=np.int64)
        one = {ord(p): i for p, i in pieces.ids.items() if len(p) == 1}
        self.single[list(one)] = list(one.values())
        self.single[ord(" ")] = self.single[ord(SPACE)]
        self.pairs: dict[int, int] = {}

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.joined[at], -1)

    def by_pair(self) -> dict[int, int]:
        """The relation as a dict, for one pair at a time; tokens below zero make keys that it doesn't have."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys[:-1].tolist(), self.joined[:-1].tolist()))
        return self.pairs


def _spelled(tokens: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of words on end, characters without a piece written as their byte pieces."""
    odd = np.flatnonzero(tokens < 0)
    if not len(odd):
        return tokens.astype(np.int32), sizes
    spelled = [[pieces.byte_ids[x] for x in chr(-2 - t).encode()] for t in tokens[odd].tolist()]
    width = np.ones(len(tokens), np.int64)
    width[odd] = list(map(len, spelled))
    ends = np.cumsum(width)
    out = np.repeat(tokens, width)
    out[np.repeat(ends[odd] - width[odd], width[odd]) + np.concatenate([np.arange(n) for n in width[odd].tolist()])] = [x for ids in spelled for x in ids]
    upto = np.cumsum(sizes)
    whole = np.concatenate(([0], ends))
    return out.astype(np.int32), np.diff(whole[upto], prepend=0)


def fold_words(words: list[str], pieces: Pieces, joins: Joins) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fold_word` by merges of many words at once: their ids on end, and the number of ids of each.

    Every round joins, in each word, the pair of neighbouring tokens that spells the best piece.
    """
    token = joins.single[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
    word = np.repeat(np.arange(len(words)), list(map(len, words)))
    joined = np.full(len(token), -1, np.int64)                     # what a token and the next one spell
    joined[:-1] = np.where(word[1:] == word[:-1], joins.of(token[:-1], token[1:]), -1)
    done_words, done_tokens = [], []
    while len(token):
        cost = joins.cost[joined]
        begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.minimum.reduceat(cost, begin)
        best = np.repeat(best, np.diff(np.append(begin, len(word))))
        left = np.isfinite(best)
        if not left.all():                                         # words without any join are done
            done_words.append(word[~left])
            done_tokens.append(token[~left])
            token, word, joined, cost, best = token[left], word[left], joined[left], cost[left], best[left]
            if not len(token):
                break
        at = np.flatnonzero(cost == best)
        at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]       # the leftmost of a word
        token[at] = joined[at]
        keep = np.ones(len(token), bool)
        keep[at + 1] = False
        token, word, joined = token[keep], word[keep], joined[keep]
        at = at - np.arange(len(at))
        touched = np.concatenate((at, at[at > 0] - 1))
        after = np.minimum(touched + 1, len(token) - 1)
        same = (word[touched] == word[after]) & (after > touched)
        joined[touched] = np.where(same, joins.of(token[touched], token[after]), -1)
    if not done_words:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    word, token = np.concatenate(done_words), np.concatenate(done_tokens)
    order = np.argsort(word, kind="stable")
    return _spelled(token[order], np.bincount(word, minlength=len(words)), pieces)


def fold_long(word: str, pieces: Pieces, joins: Joins) -> np.ndarray:
    """:func:`fold_word` by merges of a long word: a heap of joinable neighbours, so n log n."""
    token = joins.single[np.frombuffer(word.encode("utf-32-le"), "<u4")]
    both = joins.of(token[:-1], token[1:])
    cost = joins.cost[both]
    at = np.flatnonzero(both >= 0)
    heap = list(zip(cost[at].tolist(), at.tolist(), both[at].tolist()))
    heapq.heapify(heap)
    n, tokens = len(token), token.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    costs, there, joined_by = joins.cost.tolist(), bytearray(b"\1") * n, joins.by_pair().get
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, joined = pop(heap)
        j = after[i]
        if not there[i] or j >= n or joined_by(tokens[i] << 20 | tokens[j]) != joined:
            continue                                               # one of the two has been joined to another since
        tokens[i], there[j] = joined, 0
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            if (x := joined_by(joined << 20 | tokens[j])) is not None:
                push(heap, (costs[x], i, x))
        k = before[i]
        if k >= 0 and (x := joined_by(tokens[k] << 20 | joined)) is not None:
            push(heap, (costs[x], k, x))
    left = np.array(tokens, np.int64)[np.frombuffer(bytes(there), bool)]
    return _spelled(left, np.array([len(left)]), pieces)[0]


def split_words(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """:func:`words_of` of many texts at once: a code per word, the distinct words, the number of words of each text."""
    parts = [b" " + t.encode().replace(_SPACE_BYTES, b" ") if t else b"" for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    space, line = data == 0x20, data == 0x0A
    first = np.zeros(len(data), bool)
    first[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    sizes = np.array(list(map(len, parts)), np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first[begins[begins < ends]] = True
    start = np.flatnonzero(first)
    offsets = np.append(start, len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    count = np.diff(np.searchsorted(start, ends), prepend=0)
    return column.indices.to_numpy(), [w.decode() for w in column.dictionary.to_pylist()], count


class WordIds:
    """The ids of words: those of the broadcast table, and others a task has folded (a bounded number at a time)."""

    def __init__(self, pieces: Pieces, words: list[str], flat: np.ndarray, sizes: np.ndarray, viterbi: bool):
        self.pieces, self.viterbi, self.joins = pieces, viterbi, Joins(pieces)
        self.table = {w: i for i, w in enumerate(words)}
        spelled = [b"" if not t else bytes((i - pieces.byte_ids[0],)) if i in pieces.is_byte else t.replace(SPACE, " ").encode()
                   for i, t in enumerate(pieces.texts)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.width = np.array(list(map(len, spelled)), np.int64)
        self.from_ = np.cumsum(self.width) - self.width
        flat, sizes = np.asarray(flat, np.int32), np.asarray(sizes, np.int64)
        self.base = (flat, sizes, self.decodes(words, flat, sizes))
        self.reset()

    def reset(self) -> None:
        self.index = dict(self.table)
        self.flat, self.sizes, self.good = self.base
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decodes(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words their ids spell.  A word's bytes are whole characters, so this holds for texts word by word."""
        if not words:
            return np.zeros(0, bool)
        raw = [w.encode() for w in words]
        want, lengths = np.frombuffer(b"".join(raw), np.uint8), np.array(list(map(len, raw)), np.int64)
        width = self.width[flat]
        ends = np.concatenate(([0], np.cumsum(width)))
        upto = ends[np.concatenate(([0], np.cumsum(sizes)))]
        good = np.diff(upto) == lengths
        if not good.all():                                         # only words of the right length are compared
            keep = np.repeat(good, sizes)
            want = want[np.repeat(good, lengths)]
            flat, width, lengths = flat[keep], width[keep], lengths[good]
        at = np.cumsum(width)
        got = self.spelled[np.repeat(self.from_[flat] - at + width, width) + np.arange(len(want))]
        wrong = np.concatenate(([0], np.cumsum(got != want)))
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        good[good] = np.diff(wrong[cuts]) == 0
        return good

    def fold(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, which are put in the order of the result."""
        if self.viterbi:
            rest = [fold_word(w, self.pieces, True) for w in words]
            return np.array([i for r in rest for i in r], np.int32), np.array(list(map(len, rest)), np.int64)
        short = [w for w in words if len(w) <= _LONG]
        rest = [w for w in words if len(w) > _LONG]
        flat, sizes = fold_words(short, self.pieces, self.joins) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        folded = [fold_long(w, self.pieces, self.joins) for w in rest]
        words[:] = short + rest
        return np.concatenate((flat, *folded)), np.concatenate((sizes, np.array(list(map(len, folded)), np.int64)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of texts on end, the number of ids of each text, and whether they decode to it."""
        code, names, count = split_words(texts)
        known = np.fromiter(map(self.index.get, names, itertools.repeat(-1)), np.int64, len(names))
        if (known < 0).any() and len(self.index) - len(self.table) + int((known < 0).sum()) > _CACHE:
            self.reset()
            known = np.fromiter(map(self.index.get, names, itertools.repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            new = [names[i] for i in missing.tolist()]
            flat, sizes = self.fold(new)
            self.index.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.good = np.concatenate((self.good, self.decodes(new, flat, sizes)))
            self.flat = np.concatenate((self.flat, flat))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.starts = np.cumsum(self.sizes) - self.sizes
            known[missing] = [self.index[names[i]] for i in missing.tolist()]
        at = known[code]
        n = self.sizes[at]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[at] - ends + n, n) + np.arange(int(n.sum()))]
        cuts = np.cumsum(count)
        upto = np.concatenate(([0], ends))[cuts]
        wrong = np.concatenate(([0], np.cumsum(~self.good[at])))[cuts]
        return ids, np.diff(upto, prepend=0), np.diff(wrong, prepend=0) == 0


# ---------------------------------------------------------------------------
# the lattice as DataFrame operations
# ---------------------------------------------------------------------------

def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """piece, id, score: as many rows as the model has pieces."""
    return spark.createDataFrame([(p, i, float(pieces.scores[p])) for p, i in pieces.ids.items()],
                                 "piece string, id int, score double")


_MERGES = """
aggregate(array_sort(filter(edges, x -> x.e - x.s > 1)), shiftleft(1L, n + 1) - 1, (m, x) ->
  CASE WHEN (shiftright(m, x.s) & 1) = 1 AND (shiftright(m, x.e) & 1) = 1
        AND (shiftright(m, x.s + 1) & (shiftleft(1L, x.e - x.s - 1) - 1)) <> 0
        AND (shiftright(m, x.s + 1) & (shiftleft(1L, x.e - x.s - 1) - 1)
             & ((shiftright(m, x.s + 1) & (shiftleft(1L, x.e - x.s - 1) - 1)) - 1)) = 0
       THEN m ^ shiftleft(shiftright(m, x.s + 1) & (shiftleft(1L, x.e - x.s - 1) - 1), x.s + 1)
       ELSE m END)"""

_VITERBI = """
aggregate(sequence(1, n), array(struct(0D AS score, 0 AS s)), (best, i) ->
  concat(best, array(array_max(transform(filter(edges, x -> x.e = i),
    x -> struct(get(best, x.s).score - x.cost AS score, x.s AS s))))))"""

_BACK = """
aggregate(sequence(1, n), struct(n AS at, shiftleft(1L, n) AS mask), (t, i) ->
  CASE WHEN t.at = 0 THEN t
       ELSE struct(get(best, t.at).s AS at, t.mask | shiftleft(1L, get(best, t.at).s) AS mask) END).mask"""

_IDS = """
transform(starts, (a, i) -> get(filter(edges, x -> x.s = a AND x.e = coalesce(get(starts, i + 1), n)), 0).id)"""


def lattice_ids(words: DataFrame, pieces: Pieces, viterbi: bool = False) -> DataFrame:
    """Distinct ``word`` (up to 60 characters) to (word, ids); words with a character that no piece spells are left out."""
    table = piece_table(words.sparkSession, pieces)
    short = words.select("word", F.translate("word", " ", SPACE).alias("w"), F.length("word").alias("n")).where(F.col("n").between(1, _BITS))
    substrings = (short.select("word", "w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
                  .select("word", "w", "n", "s", F.explode(F.sequence(F.col("s") + 1, F.least("n", F.col("s") + LONGEST))).alias("e"))
                  .withColumn("piece", F.expr("substring(w, s + 1, e - s)")))
    edge = F.struct((-F.col("score")).alias("cost"), "s", "e", "id")
    # the piece table is the model's vocabulary: its size is fixed and doesn't follow the data
    lattice = substrings.join(F.broadcast(table), "piece").groupBy("word", "n").agg(F.collect_list(edge).alias("edges"))
    spelled = lattice.where("size(filter(edges, x -> x.e = x.s + 1)) = n")
    if viterbi:
        masked = spelled.withColumn("best", F.expr(_VITERBI)).withColumn("mask", F.expr(_BACK))
    else:
        masked = spelled.withColumn("mask", F.expr(_MERGES))
    cut = masked.withColumn("starts", F.expr("filter(sequence(0, n - 1), i -> (shiftright(mask, i) & 1) = 1)"))
    return cut.select("word", F.expr(_IDS).alias("ids"))


# ---------------------------------------------------------------------------
# whole texts
# ---------------------------------------------------------------------------

def _slices(b: pa.RecordBatch, text: str):
    """Parts of a batch of about ``_SLICE`` bytes of text, of one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < b.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, done + _SLICE)))
        yield b.slice(at, upto - at)
        at, done = upto, int(sizes[upto - 1])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n over all rows; each task adds up before anything is shuffled."""
    def run(batches):
        counts: dict[str, int] = {}

        def out():
            return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for whole in batches:
            for b in _slices(whole, "t"):
                code, names, _ = split_words(b.column(0).to_pylist())
                for w, n in zip(names, np.bincount(code, minlength=len(names)).tolist()):
                    counts[w] = counts.get(w, 0) + n
                if len(counts) > 2 * _CACHE:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = TABLE_WORDS) -> DataFrame:
    """The words of at least such a count that they are ``most`` at most, of those that fit the lattice.

    Counts are told apart by an eighth of a power of two, so the driver sees some 500 numbers.
    """
    fit = counts.where(F.length("word") <= _BITS).withColumn("level", F.floor(8 * F.log2("n")))
    least, held = None, 0
    for level, words in sorted(fit.groupBy("level").count().collect(), reverse=True):
        if held + words > most:
            break
        least, held = level, held + words
    return fit.where(F.col("level") >= least if least is not None else F.lit(False)).select("word")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = MODEL,
                 table_words: int = TABLE_WORDS, viterbi: bool = False) -> DataFrame:
    """doc_id, n_ids, ids and round_trip (decoding gives the text back) of every row."""
    spark = docs.sparkSession
    pieces = load_pieces(model)
    if max(map(len, pieces.ids)) > LONGEST:
        raise ValueError(f"the model has pieces of over {LONGEST} characters")
    counts = stage(word_counts(docs, text), "word-counts", files_for(docs))
    known = stage(lattice_ids(frequent_words(counts, table_words), pieces, viterbi), "word-ids", files_for(counts, 1))
    table = known.toArrow()                                # at most ``table_words`` words: the documented bound
    ids = table["ids"].combine_chunks()
    sizes = np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((pieces, table["word"].to_pylist(), ids.flatten().to_numpy(zero_copy_only=False), sizes, viterbi))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tag = uuid.uuid4().hex

    def run(batches):
        words = per_worker("word ids", lambda: WordIds(*shared.value), tag)
        for whole in batches:
            for b in _slices(whole, "text"):
                texts = b.column("text").to_pylist()
                flat, sizes, good = words.encode(texts)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                trips = good & np.array([SPACE not in (t or "") for t in texts], bool)      # U+2581 itself decodes to a space
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))
                yield pa.record_batch([b.column("doc_id"), pa.array(sizes.astype(np.int32)), lists, pa.array(trips, pa.bool_())],
                                      names=["doc_id", "n_ids", "ids", "round_trip"])

    return narrow.mapInArrow(run, "doc_id long, n_ids int, ids array<int>, round_trip boolean")


def decode_ids(ids: list[int], pieces: Pieces, drop: bool = True) -> str:
    """The text of ids: pieces joined, runs of byte pieces decoded as UTF-8, spaces put back, the leading one dropped."""
    if not ids:
        return ""
    low, high = pieces.byte_ids[0], pieces.byte_ids[255]
    texts = pieces.texts
    if not any(map(pieces.is_byte.__contains__, set(ids))):
        joined = "".join([texts[i] for i in ids])
    else:
        raw = b"".join([bytes((i - low,)) if low <= i <= high else texts[i].encode() for i in ids])
        joined = raw.decode("utf-8", "replace")
    joined = joined.replace(SPACE, " ")
    return joined[1:] if drop and joined[:1] == " " else joined


def decode_texts(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The columns of ``encoded`` but ``ids``, and ``text``."""
    pieces = load_pieces(model)
    others = [c for c in encoded.columns if c != ids]
    schema = encoded.select(*others, F.lit("").alias("text")).schema

    def run(batches):
        for b in batches:
            texts = [decode_ids(x or [], pieces) for x in b.column(ids).to_pylist()]
            yield b.select(others).append_column("text", pa.array(texts, pa.string()))

    return encoded.select(*others, ids).mapInArrow(run, schema)


def op9(docs: DataFrame) -> DataFrame:
    return encode_texts(docs)
