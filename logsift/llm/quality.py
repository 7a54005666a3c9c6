"""Quality classifier: a generalised additive model with pairwise interactions.

``text_features`` turns each whole text into numbers (one Arrow pass, no
shuffle).  ``fit_gam`` learns one lookup table per feature by cyclic gradient
boosting: round after round, each feature in turn gets a shallow tree over its
bins that is shrunk and added to its table.  The strongest pairs of features,
ranked by what they still explain, get two-dimensional tables in the same way.
``score`` adds up the bins' entries, vectorised over the batch.

Only the fit sees a sample: at most ``MAX_TRAIN`` labelled rows, those with the
smallest hash of ``doc_id``.  Every document is scored.

Defined cases: null text counts as empty; null ``doc_id`` scores normally and
is never a training row; rows that repeat score alike; labels that disagree for
a ``doc_id`` count as their rounded mean; with no usable label the score is 1.0
for every text (nothing was learned, so nothing is rejected).
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import files_for, hash_sample, raw, schema_with, stage

MAX_TRAIN = 20_000
KEEP_AT = 0.7

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digit", "space", "newline", "tab", "high", "letters",
    "exclaim", "pipe", "stops", "commas", "symbols", "markup", "entropy", "distinct_words", "top_word", "repeats",
    "bigram_distinct", "top_bigram", "short_words", "long_words", "capital_words", "marked_words", "lines_distinct",
    "words_per_line", "longest_word", "periodic",
)

_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" ", "newline": b"\n\r", "tab": b"\t",
    "high": bytes(range(128, 256)), "letters": b"abcdefghijklmnopqrstuvwxyz", "exclaim": b"!?", "pipe": b"|",
    "stops": b".", "commas": b",;:", "symbols": b"#$%&*@^~=+_", "markup": b"<>{}[]()/\\",
}
_MASKS = np.array([[b in chars for b in range(256)] for chars in _CLASS.values()], dtype=np.float64)
_MARKED = re.compile(rb"[^0-9A-Za-z\x80-\xff.,][ \n]")


def features_of(text: bytes) -> list[float]:
    """The numbers of one text, in the order of ``FEATURES``."""
    size = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if size else np.zeros(256)
    share = hist / max(size, 1)
    p = share[share > 0]
    words = text.lower().split()
    n = len(words)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = text.split(b"\n")
    m, k = max(n, 1), max(n - 1, 1)
    # a text that loops has one gap between most words and their last occurrence
    last, gaps = {}, []
    for i, w in enumerate(words):
        if w in last:
            gaps.append(i - last[w])
        last[w] = i
    periodic = float(np.bincount(gaps).max()) / m if gaps else 0.0
    return [
        math.log1p(size), math.log1p(n), size / m, *(_MASKS @ share), float(-(p * np.log2(p)).sum()) if size else 0.0,
        len(counts) / m, max(counts.values(), default=0) / m, sum(map(bytes.__eq__, words, words[1:])) / k,
        len(pairs) / k, max(pairs.values(), default=0) / k, float((lengths <= 3).sum()) / m,
        float((lengths >= 10).sum()) / m, sum(w[:1].isupper() for w in text.split()) / m,
        len(_MARKED.findall(text)) / m, len(set(lines)) / len(lines), n / len(lines),
        math.log1p(int(lengths.max()) if n else 0), periodic,
    ]


def text_features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``features`` (array of float) of every row, empty and null texts included."""
    narrow = docs.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("features"))
    schema = schema_with(docs.select(*keep), features=T.ArrayType(T.FloatType()))

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("features")
            rows = [features_of(t) for t in raw(b.column(at))]
            values = pa.array(np.array(rows, np.float32).ravel())
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
            yield b.set_column(at, "features", pa.ListArray.from_arrays(offsets, values))

    return narrow.mapInArrow(run, schema)


@dataclass
class Gam:
    """Lookup tables: ``edges[j]`` cuts feature j into bins, ``tables[j]`` holds a number per bin."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.edges, self.tables)):
            z += values[np.searchsorted(cuts, x[:, j], side="right")]
        for a, b, values in self.pairs:
            z += values[np.searchsorted(self.pair_edges[a], x[:, a], side="right"),
                        np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, reg: float) -> np.ndarray:
    """Shallow tree over ordered bins with gradient sums g and hessian sums h: a value per bin."""
    def best(lo: int, hi: int):
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if hi - lo < 2:
            return 0.0, lo
        left, right = cg[:-1] ** 2 / (ch[:-1] + reg), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + reg)
        gain = left + right - cg[-1] ** 2 / (ch[-1] + reg)
        i = int(np.argmax(gain))
        return float(gain[i]), lo + i + 1

    parts = [(0, len(g))]
    while len(parts) < leaves:
        gains = [best(*p) for p in parts]
        i = max(range(len(parts)), key=lambda k: gains[k][0])
        if gains[i][0] <= 1e-9:
            break
        parts[i:i + 1] = [(parts[i][0], gains[i][1]), (gains[i][1], parts[i][1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + reg)
    return out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 48, leaves: int = 4,
            n_pairs: int = 10, pair_bins: int = 8, pair_rounds: int = 50, reg: float = 4.0) -> Gam:
    """Cyclic boosting of one shallow tree per feature and round, then of the strongest pairs."""
    if len(y) == 0:
        return Gam(base=30.0)
    prior = (y.sum() + 1.0) / (len(y) + 1.0 + (y.min() == 0))
    model = Gam(base=float(np.log(prior / max(1 - prior, 1e-6))))
    if y.min() == y.max():
        return model
    p = x.shape[1]
    model.edges = [_cuts(x[:, j], bins) for j in range(p)]
    model.tables = [np.zeros(len(c) + 1) for c in model.edges]
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.edges)]
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for j in range(p):
            q = 1.0 / (1.0 + np.exp(-z))
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(binned[j], y - q, size), np.bincount(binned[j], q * (1 - q), size), leaves, reg)
            model.tables[j] += step
            z += step[binned[j]]
    model.pair_edges = [_cuts(x[:, j], pair_bins) for j in range(p)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_edges)]
    shape = [len(c) + 1 for c in model.pair_edges]
    q = 1.0 / (1.0 + np.exp(-z))
    left = []
    for a, b in itertools.combinations(range(p), 2):
        cell = coarse[a] * shape[b] + coarse[b]
        g, h = np.bincount(cell, y - q), np.bincount(cell, q * (1 - q))
        left.append((float((g ** 2 / (h + reg)).sum()), a, b))
    chosen = [(a, b, np.zeros((shape[a], shape[b]))) for _, a, b in sorted(left, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, values in chosen:
            q = 1.0 / (1.0 + np.exp(-z))
            cell = coarse[a] * shape[b] + coarse[b]
            size = shape[a] * shape[b]
            g = np.bincount(cell, y - q, size).reshape(values.shape)
            h = np.bincount(cell, q * (1 - q), size).reshape(values.shape)
            cut = _tree(g.sum(1), h.sum(1), 2, reg)          # one cut on a, then one on b within each side
            step = np.zeros_like(values)
            for side in np.unique(cut):
                rows = cut == side
                step[rows] = _tree(g[rows].sum(0), h[rows].sum(0), 2, reg)
            values += rate * step
            z += rate * step[coarse[a], coarse[b]]
    model.pairs = chosen
    return model


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose label is never learned: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                   label: str = "quality", max_train: int = MAX_TRAIN, threshold: float = KEEP_AT,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every row of ``docs``: id, ``keep`` columns, held_out, score, predicted."""
    feats = stage(text_features(docs, text, (id_col, *[c for c in keep if c != id_col])), "quality-features",
                  files_for(docs))
    known = (labels.select(F.col(id_col).alias("label_id"), F.col(label).alias("y"))
             .where("label_id is not null and y is not null")
             .groupBy("label_id").agg(F.round(F.avg("y")).cast("double").alias("y"))
             .where(~held_out(F.col("label_id"))))
    ids = feats.select(F.col(id_col).alias("label_id")).where("label_id is not null").distinct()
    usable = known.join(ids, "label_id", "left_semi")
    sample = hash_sample(usable, "label_id", max_train, usable.count())
    # at most max_train rows: the documented bound of the training sample
    train = feats.join(F.broadcast(sample), feats[id_col] == sample["label_id"])
    # of rows that share an id, the one with the smallest features
    train = train.groupBy("label_id").agg(F.min("features").alias("features"), F.first("y").alias("y"))
    rows = train.orderBy("label_id").toPandas()
    x = np.array(rows.features.tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return score_features(feats, fit_gam(x, rows.y.to_numpy(dtype=np.float64)), id_col, threshold)


def score_features(feats: DataFrame, model: Gam, id_col: str, threshold: float) -> DataFrame:
    """Vectorised lookup of the model's tables for a frame with ``features``."""
    others = [c for c in feats.columns if c != "features"]
    schema = schema_with(feats.select(*others), score="double")

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("features")
            x = np.asarray(b.column(at).flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            x = x.reshape(b.num_rows, len(FEATURES))
            out = b.remove_column(at)
            yield out.append_column("score", pa.array(model.score(x)))

    scored = feats.mapInArrow(run, schema)
    return scored.select(*others, held_out(F.col(id_col)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
