"""Phrase collocations by mergeable Misra-Gries summaries and an exact second count.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and
into words; phrases are runs of 2 to ``LONGEST`` words of a piece, per language.

1. Levels (``frequent_hashes``): words, then pairs of frequent words, then longer
   runs whose pairs are all frequent.  A scan task counts hashes of n-grams and
   sends a summary (hashes, counts) per hash bucket; equal hashes meet in one
   bucket, where summaries are merged by Misra-Gries (``Summary``).  Its capacity
   exceeds the bucket's mass divided by the threshold, so every n-gram that is
   frequent survives.  A hot n-gram is a few numbers per task by then.
2. The survivors of a level set bits in a bitmap of fixed size (``BITS``), the
   only thing that is broadcast.  However full it is, it lets every survivor
   through; the next scan leaves out the rest.
3. Second count: n-grams that pass the bitmaps of all levels are counted by their
   text, in a task and then per hash bucket, and those below the threshold go.
4. Cuts of a phrase into two parts are equi-joined to the counts; scores are exact
   decimals; phrases inside equally frequent longer ones go; each language's best
   are found in three steps, so that no task orders a whole language.

Defined cases: null text counts as empty, a null language as ``und``; rows that
repeat count again, with or without an id; only the named columns are read, so
other columns may have any name; texts are read in slices that end at a piece's
end, so memory follows the longest piece, not the longest text; ties are ordered
by phrase; an empty table gives an empty result.  Counts must stay below 1e15.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import files_for, partitions, raw, stage

LEAST = 100               # occurrences of a candidate
LONGEST = 5               # words of a candidate
BEST = 2000               # phrases reported of each language
SHARE = 100               # percent of its occurrences inside a longer candidate that drop a phrase
BITS = 26                 # a bitmap has 2 ** BITS bits
ROOM = 1 << 20            # counters of a summary; its capacity is half of them
SLICE = 8 << 20           # bytes of text taken at once
_HELD = 1 << 22           # hashes a task holds before it sends a summary
_PHRASES = 1 << 19        # n-grams a task holds, as text, before it adds them up and sends them
_BUCKETS = 4              # hash buckets for each reducing task
_BYTES = 32 << 20         # input bytes for each reducing task, at most
_CUT = re.compile(rb"[.,;:!?\n-\r]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)                       # 0 in words, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a slice of texts in order: code (of ``names``), lang (of ``langs``), tied (in one piece with the next)."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        order = sorted(range(len(texts)), key=lambda i: number[langs[i]])
        data = np.frombuffer(b"\n".join([texts[i] for i in order]) + b"\n", np.uint8)
        kind = _KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        start, end = edge[0::2], edge[1::2]
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=offsets[1:])
        column = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
        coded = column.dictionary_encode()
        self.code, self.names = coded.indices.to_numpy(), coded.dictionary
        piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        self.tied = np.zeros(len(start), bool)
        self.tied[:-1] = piece[1:] == piece[:-1]
        size = np.array([len(texts[i]) + 1 for i in order], np.int64)
        per = np.diff(np.searchsorted(start, np.cumsum(size)), prepend=0)
        self.lang = np.repeat(np.array([number[langs[i]] for i in order], np.int16), per)

    def hashes(self) -> np.ndarray:
        """A hash of language and word, word by word."""
        digest = xxhash.xxh3_64_intdigest
        names = np.fromiter(map(digest, self.names.to_pylist()), np.uint64, len(self.names))
        seeds = np.fromiter((digest(x.encode(), 1) for x in self.langs), np.uint64, len(self.langs))
        self.plain = names[self.code]
        return _mix(self.plain + seeds[self.lang])

    def grams(self, maps: list[np.ndarray], upto: int):
        """(k, places, hashes) of the runs of k = 1 to ``upto`` words whose parts pass the bitmaps of lower levels.

        ``maps``: of words, pairs and longer runs, as far as known.
        """
        h = self.hashes()
        at = np.arange(len(h))
        pairs = None
        for k in range(1, upto + 1):
            if k > 1:
                fits = at + k - 1 < len(self.code)
                at, h = at[fits], h[fits]
                on = self.tied[at + k - 2]
                # the run without its last word has passed; so must the last word (of a pair) or the last pair
                on &= words[at + 1] if k == 2 else pairs[at + k - 2]
                at, h = at[on], h[on]
                h = _mix(h * _ODD + self.plain[at + k - 1])
            yield k, at, h
            if len(maps) >= min(k, 3) and k < upto:
                on = passes(maps[min(k, 3) - 1], h) if k < 3 else np.ones(len(h), bool)
                if k < 3:
                    found = np.zeros(len(self.code), bool)
                    found[at[on]] = True
                    words, pairs = (found, pairs) if k == 1 else (words, found)
                at, h = at[on], h[on]


def _positions(h: np.ndarray):
    for shift in (0, BITS):
        yield (h >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)


def passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    on = np.ones(len(h), bool)
    for p in _positions(h):
        on &= (bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return on


def slices(batches, text: str = "text", lang: str = "lang"):
    """Slices of whole texts, or of whole pieces of a long one, as :class:`Words`."""
    held, langs, size = [], [], 0
    for b in batches:
        for t, x in zip(raw(b.column(text)), b.column(lang).to_pylist()):
            at = 0
            while at < len(t):
                cut = _CUT.search(t, at + SLICE) if len(t) - at > SLICE else None
                upto = cut.end() if cut else len(t)
                held.append(t[at:upto])
                langs.append("und" if x is None else x)
                size += upto - at
                at = upto
                if size >= SLICE:
                    yield Words(held, langs)
                    held, langs, size = [], [], 0
    if held:
        yield Words(held, langs)


def combined(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes added up, in order."""
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    h, n = h[order], n[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
    return h[new], np.add.reduceat(n, new) if len(new) else n


class Summary:
    """A Misra-Gries summary of hashes that keeps every hash of ``least`` or more occurrences.

    It holds up to ``room`` counters.  Beyond that it subtracts from all what
    leaves half of them, and ``error`` is what it has subtracted in all: a
    counter is at least the count less ``error``.  A subtraction of c takes
    c * room / 2 from the mass, so while room / 2 exceeds mass / least the error
    stays below ``least``; if a bucket's mass is larger than planned, room doubles.
    """

    def __init__(self, least: int, room: int = ROOM):
        self.least, self.room, self.error = least, room, 0
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list = []
        self.waiting = 0

    def merge(self, h: np.ndarray, n: np.ndarray) -> None:
        self.new.append((h, n))
        self.waiting += len(h)
        if self.waiting >= self.room:
            self.settle()

    def settle(self) -> None:
        self.h, self.n = combined([self.h, *(h for h, _ in self.new)], [self.n, *(n for _, n in self.new)])
        self.new, self.waiting = [], 0
        while len(self.h) > self.room:
            half = self.room // 2
            cut = int(np.partition(self.n, len(self.n) - half - 1)[len(self.n) - half - 1])
            if self.error + cut >= self.least:
                self.room *= 2
                continue
            self.error += cut
            keep = self.n > cut
            self.h, self.n = self.h[keep], self.n[keep] - cut

    def survivors(self) -> np.ndarray:
        self.settle()
        return self.h[self.n + self.error >= self.least]


def _narrow(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(text).cast("binary").alias("text"), F.col(lang).cast("string").alias("lang"))


def frequent_hashes(texts: DataFrame, maps, level: int, least: int, tasks: int, longest: int, room: int = ROOM) -> DataFrame:
    """h (long) of every n-gram of ``level`` (1 words, 2 pairs, 3 longer) that occurs ``least`` times, and of few others."""
    lengths = range(level, level + 1 if level < 3 else longest + 1)
    buckets = _BUCKETS * tasks

    def count(batches):
        held, counts, size = [], [], 0

        def send():
            h, n = combined(held, counts)
            upto = np.searchsorted(h, (np.arange(1, buckets, dtype=object) << 64) // buckets, side="left") if len(h) else []
            bounds = [0, *(int(x) for x in upto), len(h)]
            parts = [(i, h[a:b].tobytes(), n[a:b].astype("<u4").tobytes())
                     for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
            bucket, hs, ns = zip(*parts) if parts else ((), (), ())
            return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(hs, pa.binary()), pa.array(ns, pa.binary())],
                                   names=["bucket", "hashes", "counts"])

        shared = [m.value for m in maps]
        for words in slices(batches):
            for k, _, h in words.grams(shared, lengths[-1]):
                if k in lengths and len(h):
                    h, n = combined([h], [np.ones(len(h), np.int64)])
                    held.append(h)
                    counts.append(n)
                    size += len(h)
            if size >= _HELD:
                yield send()
                held, counts, size = [], [], 0
        if held:
            yield send()

    def reduce(batches):
        summary = Summary(least, room)
        for b in batches:
            for h, n in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist()):
                summary.merge(np.frombuffer(h, np.uint64), np.frombuffer(n, "<u4").astype(np.int64))
        yield pa.record_batch([pa.array(summary.survivors().view(np.int64))], names=["h"])

    sent = texts.mapInArrow(count, "bucket int, hashes binary, counts binary").repartition(tasks, "bucket")
    return sent.mapInArrow(reduce, "h long")


def bitmap(hashes: DataFrame):
    """The bits of the hashes as a broadcast array of 2 ** BITS bits: that many, whatever the number of hashes."""
    mask = (1 << BITS) - 1
    bits = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", BITS).bitwiseAND(mask))).alias("p"))
    slots = bits.select(F.shiftright("p", 6).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(p & 63 AS INT))").alias("bit"))
    found = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _added(tables: list[pa.Table]) -> pa.Table:
    """Equal n-grams added up, exactly (by their text)."""
    sums = pa.concat_tables(tables).group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("n", "sum"), ("h", "min")])
    return sums.rename_columns([{"n_sum": "n", "h_min": "h"}.get(c, c) for c in sums.column_names]).select([*_COUNTED.names, "h"])


def exact_counts(texts: DataFrame, maps, least: int, tasks: int, longest: int) -> DataFrame:
    """lang, phrase, words, n of the n-grams of ``least`` occurrences that pass the bitmaps; phrase '' has a language's words.

    As in the first pass a task adds up what it finds and sends a part per hash bucket.
    """
    buckets = _BUCKETS * tasks

    def found(w: Words, shared):
        digest = xxhash.xxh3_64_intdigest
        yield table(w, np.arange(len(w.langs)), pa.array([""] * len(w.langs)), 0, np.bincount(w.lang, minlength=len(w.langs)),
                    np.fromiter((digest(x.encode(), 2) for x in w.langs), np.uint64, len(w.langs)))
        code = np.zeros(len(w.code), np.int64)                    # of the run that begins at a word
        for k, at, h in w.grams(shared, longest):
            on = passes(shared[min(k, 3) - 1], h)
            at, h = at[on], h[on]
            if not len(at):
                continue
            if k == 1:
                whole = w.code[at].astype(np.int64) * len(w.langs) + w.lang[at]
            else:
                whole = code[at] * len(w.names) + w.code[at + k - 1]
            _, first, inverse, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            code[at] = inverse
            own = at[first]
            parts = [w.names.take(pa.array(w.code[own + i])) for i in range(k)]
            joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ")) if k > 1 else parts[0]
            yield table(w, w.lang[own], joined.cast(pa.string()), k, n, h[first])

    def table(w, lang, phrase, k, n, h):
        names = pa.array(w.langs, pa.string()).take(pa.array(lang.astype(np.int32)))
        return pa.table([names, phrase, pa.array(np.full(len(n), k, np.int32)), pa.array(n.astype(np.int64)), pa.array(h)],
                        names=[*_COUNTED.names, "h"])

    def count(batches):
        shared = [m.value for m in maps]
        held, size = [], 0

        def send(rows):
            bucket = ((rows["h"].to_numpy() >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = rows.select(_COUNTED.names).take(pa.array(order)).combine_chunks()
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _COUNTED) as out:
                    out.write_table(rows.slice(x, y - x))
                yield int(bucket[order[x]]), sink.getvalue().to_pybytes()

        def batch(rows):
            number, parts = zip(*send(rows))
            return pa.record_batch([pa.array(number, pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "part"])

        for w in slices(batches):
            for rows in found(w, shared):
                held.append(rows)
                size += len(rows)
            if size > _PHRASES:
                held = [_added(held)]
                size = len(held[0])
                if size > _PHRASES // 2:
                    yield batch(held[0])
                    held, size = [], 0
        if size:
            yield batch(_added(held))

    def add(batches):
        held, size = [], 0
        for b in batches:
            for part in b.column("part").to_pylist():
                rows = pa.ipc.open_stream(part).read_all()
                held.append(rows.append_column("h", pa.array(np.zeros(len(rows), np.uint64))))
                size += len(rows)
                if size > 4 * _PHRASES:
                    held = [_added(held)]
                    size = len(held[0])
        if held:
            rows = _added(held).select(_COUNTED.names)
            yield from rows.filter(pc.or_(pc.greater_equal(rows["n"], least), pc.equal(rows["words"], 0))).to_batches()

    sent = texts.mapInArrow(count, "bucket int, part binary").repartition(tasks, "bucket")
    return sent.mapInArrow(add, "lang string, phrase string, words int, n long")


_SCORE = """CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(16,0))
  div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))"""


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every candidate, at its lowest-scoring cut."""
    parts = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), parts.alias("w"))
    cuts = candidates.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"),
                       F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("right"))
    known = counts.where("words > 0")
    left = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    total = counts.where("words = 0").select("lang", "n")
    joined = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(total, "lang")
    best = joined.withColumn("score", F.expr(_SCORE)).groupBy("lang", "phrase", "words", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def outermost(candidates: DataFrame, share: int) -> DataFrame:
    """The candidates without those of which a longer one holds ``share`` percent of the occurrences.

    A run one word longer that a still longer one contains is at least as frequent, so one step suffices.
    """
    inner = candidates.where("words > 2").select("lang", F.split("phrase", " ").alias("w"), F.col("a").alias("longer"), "words")
    inner = inner.select("lang", "longer", F.explode(F.expr(
        "array(array_join(slice(w, 1, words - 1), ' '), array_join(slice(w, 2, words - 1), ' '))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return candidates.join(inner, ["lang", "phrase"], "left").where(
        F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * share).drop("longer")


def best_of_each(scores: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of every language with their rank, through ever fewer groups."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups, salt = partitions(scores.sparkSession), F.xxhash64("phrase")
    while groups > 1:
        w = Window.partitionBy("lang", F.pmod(salt, F.lit(groups))).orderBy(*order)
        scores = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
        groups //= 16
    w = Window.partitionBy("lang").orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, words, n: all words and phrases of ``least`` or more occurrences, and every language's words as phrase ''."""
    texts = _narrow(docs, text, lang)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(partitions(docs.sparkSession), -(-size // _BYTES))
    files, maps = files_for(docs), []
    for level in (1, 2, 3):
        found = stage(frequent_hashes(texts, maps, level, least, tasks, longest), f"phrases-{level}", files)
        maps.append(bitmap(found))
    return stage(exact_counts(texts, maps, least, tasks, longest), "phrase-counts", files)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 most: int = BEST, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of every language's ``most`` best phrases."""
    scores = scored(phrase_counts(docs, text, lang, least, longest))
    best = best_of_each(outermost(scores, share), most)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(docs: DataFrame) -> DataFrame:
    return collocations(docs)


def oracle_sql() -> str:
    upper = "".join(map(chr, range(65, 91)))
    later = range(2, LONGEST + 1)
    follow = ", ".join(f"lead(w, {k - 1}) OVER o AS w{k}" for k in later)
    parts = ", ".join(f"CASE WHEN k >= {k} THEN w{k} END" for k in later)
    there = " OR ".join(f"k = {k} AND w{k} IS NOT NULL" for k in later)
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, regexp_split_to_array(
    translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
u AS (SELECT lang, doc, unnest(range(1, len(pieces) + 1)) AS no, unnest(pieces) AS piece FROM p),
v AS (SELECT lang, doc, no, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM u),
w AS (SELECT lang, doc, no, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM v),
n AS (SELECT lang, w AS w1, {follow} FROM w WINDOW o AS (PARTITION BY doc, no ORDER BY i)),
g AS (SELECT lang, k, concat_ws(' ', w1, {parts}) AS phrase FROM n, range(1, {LONGEST + 1}) t(k) WHERE k = 1 OR ({there})),
f AS (SELECT lang, k, phrase, count(*) AS f, lang || chr(10) || phrase AS key FROM g GROUP BY lang, k, phrase),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST}),
x AS (SELECT c.*, j, lang || chr(10) || array_to_string(ws[1:j], ' ') AS lp, lang || chr(10) || array_to_string(ws[j + 1:], ' ') AS rp FROM c, range(1, {LONGEST}) u(j) WHERE j < k),
s AS (SELECT x.lang, x.phrase, x.k, x.a, x.j, l.f AS l, r.f AS r, n, (1000 * x.a::HUGEINT * n) // (l.f::HUGEINT * r.f) AS score
    FROM x JOIN f l ON l.key = x.lp JOIN f r ON r.key = x.rp JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT DISTINCT c.lang, array_to_string(c.ws[v:v + m - 1], ' ') AS phrase, c.a AS longer FROM c, range(1, {LONGEST}) y(v), range(2, {LONGEST}) z(m)
    WHERE m < k AND v + m - 1 <= k),
d AS (SELECT lang, phrase, max(longer) AS longer FROM o GROUP BY ALL),
q AS (SELECT b.* FROM b LEFT JOIN d USING (lang, phrase) WHERE coalesce(longer, 0) * 100 < b.a * {SHARE}),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM k WHERE rank <= {BEST}"""
