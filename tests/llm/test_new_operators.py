"""Source mixing, phrase collocations and cross-tokenizer alignment against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift.llm import alignment, collocations, mixing
from logsift.llm.common import table

from .conftest import ODD


def rows_of(spark, odd, small, which):
    docs = odd if which == "odd" else table(spark, small, "documents")
    return docs, [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


# -- mixing -------------------------------------------------------------------

def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Sources in order -> targets, resharing the excess until none is above."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in stopped]
        left = total - sum(most * sizes[s] for s in stopped)
        level = Fraction(left, sum(w[s] for s in rest)) if rest else 0
        above = {s for s in rest if level * w[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in stopped else level * w[s] for s in sizes}
        stopped |= above


def plain_mix(rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for i, r in enumerate(rows)}
    sizes = defaultdict(int)
    for i, r in enumerate(rows):
        sizes[r[3]] += len(words[i])
    sizes = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, (s or "").encode()))}
    targets, out = plain_targets(sizes), []
    for s, size in sizes.items():
        def key(i):
            digest = hashlib.md5(f"{mixing.SEED}:{'' if rows[i][0] is None else rows[i][0]}:{rows[i][1] or ''}".encode()).hexdigest()
            w = words[i]
            return -math.log((int(digest[:13], 16) + 0.5) / (1 << 52)) / (0.1 + 0.9 * len(set(w)) / len(w) if w else 1.0), digest
        epochs = int(targets[s] // size) if size else 0
        left = math.floor(targets[s] - epochs * size + Fraction(1, 2))
        for i in sorted((i for i, r in enumerate(rows) if r[3] == s), key=key):
            n = len(words[i])
            out.append((rows[i][0], n, size, round(float(targets[s]), 6), epochs * n + max(0, min(n, left))))
            left -= n
    return out


@pytest.mark.parametrize("which", ["odd", "table"])
def test_mix_against_a_plain_one(spark, odd, small, which):
    docs, rows = rows_of(spark, odd, small, which)
    got = mixing.op13(docs).collect()
    order = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=order) == sorted(plain_mix(rows), key=order)
    assert all(r.taken <= 3 * r.size for r in got)


def test_mix_prefers_heavy_rows_and_repeats(frame):
    rows = [(i, "w x y z " * 25, "en", "big", 5) for i in range(400)] + [(i, "a b c", "en", "tiny", 3) for i in range(400, 404)]
    docs = frame(rows).withColumn("taken", F.lit("x")).withColumn("size", F.lit("y"))
    heavy = F.when(F.col("doc_id") % 2 == 0, 100.0).otherwise(1.0)
    a, b = (mixing.mix(docs, weight=heavy, keep=("taken", "size"), weights=(1, 3)).collect() for _ in range(2))
    assert sorted(a) == sorted(b) and all(r.row == ("x", "y") for r in a)
    tiny = [r for r in a if r.source_size == 12]
    assert all(r.taken == 9 and r.epochs == 3 for r in tiny)                       # stopped at three times
    big = [r for r in a if r.source_size != 12]
    assert sum(r.taken for r in big) == round(big[0].target) == 400 * 100 + 12 - 36
    none = [r for r in big if not r.taken]
    assert len(none) < 2 and all(r.doc_id % 2 for r in none)
    out = mixing.copies(mixing.mix(docs, weights=(1, 3))).groupBy("doc_id").agg(F.sum("words").alias("n")).collect()
    taken = {r.doc_id: r.taken for r in mixing.op13(docs.drop("taken", "size")).collect() if r.taken}
    assert len(out) >= 400 and all(r.n <= 300 for r in out) and len(taken) >= 400


def test_weighted_keys_pick_heavy_rows_first(frame):
    docs = frame([(i, "a b c d", "en", "x" if i < 300 else "y", 7) for i in range(600)])
    heavy = F.when(F.col("doc_id") % 3 == 0, 50.0).otherwise(1.0)
    got = mixing.mix(docs, weight=heavy, weights=(1, 5)).where("source_size = 1200 and epochs = 0 and taken > 0").collect()
    assert len(got) == 100 and sum(r.doc_id % 3 == 0 for r in got) > 85


@given(st.lists(st.integers(0, 60), min_size=1, max_size=7))
@settings(max_examples=15, deadline=None)
def test_budgets_of_any_sizes(spark, sizes):
    sources = spark.createDataFrame([(str(i), n, (1, 2, 3)[i % 3]) for i, n in enumerate(sizes)], "code string, source_size long, weight int")
    got = {r.code: r.target for r in mixing.word_budgets(sources, 3).collect()}
    want = plain_targets({str(i): n for i, n in enumerate(sizes)}) if sum(sizes) else {c: 0 for c in got}
    assert all(abs(got[c] - float(want[c])) < 1e-9 for c in got) and abs(sum(got.values()) - sum(sizes)) < 1e-6


# -- collocations ---------------------------------------------------------------

def plain_collocations(rows, least, longest=5, most=2000, share=100):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for p, a in candidates.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                inner = (p[0], *p[i:i + k])
                inside[inner] = max(inside[inner], a)
    scored = defaultdict(list)
    for p, a in candidates.items():
        if 100 * inside[p] >= share * a:
            continue
        cuts = []
        for k in range(1, len(p) - 1):
            left, right = f[p[:k + 1]], f[(p[0], *p[k + 1:])]
            cuts.append((1000 * a * n[p[0]] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        scored[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score) for lang, found in scored.items()
                  for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:most]))


@pytest.mark.parametrize("which", ["odd", "table"])
def test_collocations_against_a_plain_count(spark, odd, small, which):
    docs, rows = rows_of(spark, odd, small, which)
    least = 2 if which == "odd" else 12
    got = collocations.collocations(docs, least=least, most=40).collect()
    want = plain_collocations(rows, least, most=40)
    assert sorted(map(tuple, got)) == want and want


def test_slices_end_at_pieces(frame, monkeypatch):
    text = "Alpha beta, gamma delta! " * 50 + "long piece without an end " * 40
    rows = [(1, text, None, "a", 0), (2, text.upper(), "en", "a", 0), (3, ". . ,", "en", "a", 0), (None, "alpha beta", None, "a", 0)]
    monkeypatch.setattr(collocations, "SLICE", 64)
    monkeypatch.setattr(collocations, "_HELD", 10)
    got = collocations.collocations(frame(rows), least=5, most=100).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 5, most=100)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=300), st.integers(2, 40), st.integers(2, 16))
@settings(max_examples=60, deadline=None)
def test_summaries_keep_every_frequent_hash(parts, least, room):
    summary, counts = collocations.Summary(least, room), Counter()
    for h, n in parts:
        counts[h] += n
        summary.merge(np.array([h], np.uint64), np.array([n], np.int64))
    found = set(summary.survivors().tolist())
    assert {h for h, n in counts.items() if n >= least} <= found
    assert summary.error < least and summary.room <= max(room, 4 * (sum(counts.values()) // least + 1))


def test_hot_phrase_and_clashing_columns(frame):
    rows = [(i, "new york city hall is open", "en", "a", 1) for i in range(120)] + [(i, f"x{i} y{i}", "en", "a", 1) for i in range(240)]
    docs = frame(rows).withColumn("phrase", F.lit("p")).withColumn("h", F.lit(1)).withColumn("n", F.lit(2)).withColumn("rank", F.lit(2))
    got = collocations.collocations(docs).collect()
    assert [(r.phrase, r.a, r.rank) for r in got] == [("new york city hall is", 120, 1), ("york city hall is open", 120, 2)]


# -- alignment --------------------------------------------------------------------

def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(alignment.TOKENIZER)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL)
    both = alignment.Tokenizers(alignment.TOKENIZER, alignment.MODEL)
    out, counts = [], Counter()
    for doc, text, *_ in rows:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        parts_a, parts_b = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            out.append((doc, [], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, parts_a))).tolist(), np.cumsum(list(map(len, parts_b))).tolist()
        joint = sorted(set(ends_a) & set(ends_b))
        cuts = [(ends_a.index(e) + 1, ends_b.index(e) + 1) for e in joint] if len(joint) < 3000 else None
        if cuts is None:
            place_a, place_b = {e: i + 1 for i, e in enumerate(ends_a)}, {e: i + 1 for i, e in enumerate(ends_b)}
            cuts = [(place_a[e], place_b[e]) for e in joint]
        groups = [(a[i:x], b[j:y]) for (i, j), (x, y) in zip([(0, 0), *cuts], cuts)]
        counts.update((g[-1], h[-1]) for g, h in groups)
        out.append((doc, a, b, groups))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for doc, a, b, groups in out:
        links = [(g[-1], h[-1]) for g, h in groups]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (doc, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
               sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else "")


@pytest.mark.parametrize("which, part_rows", [("odd", 1 << 20), ("odd", 50), ("table", 1 << 20)])
def test_alignment_against_a_plain_one(spark, odd, frame, small, which, part_rows):
    docs, rows = rows_of(spark, odd, small, which)
    if which == "odd":
        rows = [*rows, (50, "a ▁ b", "en", "a"), (51, "x" * 3000 + "é" * 900, "en", "a"), (52, "<s> <unk> </s> <0x41>", "en", "a")]
        docs = frame([(*r, 0) for r in rows]).withColumn("a", F.lit("clash")).withColumn("n_best", F.lit("clash"))
    got = alignment.alignment_links(docs, part_rows=part_rows).collect()
    order = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=order) == sorted(plain_alignment(rows), key=order)


def test_groups_of_real_texts(odd):
    both = alignment.Tokenizers(alignment.TOKENIZER, alignment.MODEL)
    texts = {r[0]: r[1] for r in ODD}
    for r in alignment.align_documents(odd).collect():
        assert len(r.a_ends) == len(r.b_ends) and (not r.a_ids or r.a_ends[-1] == len(r.a_ids) and r.b_ends[-1] == len(r.b_ids))
        spelled = [b"".join(both.a_bytes[i] for i in r.a_ids[x:y]) == b"".join(both.b_bytes[i] for i in r.b_ids[z:w])
                   for (x, z), (y, w) in zip([(0, 0), *zip(r.a_ends, r.b_ends)], zip(r.a_ends, r.b_ends))]
        assert all(spelled) and (r.doc_id != 16 or b"".join(both.b_bytes[i] for i in r.b_ids) == (" " + texts[16]).encode())


@given(st.lists(st.tuples(st.sets(st.integers(1, 400), max_size=200), st.sets(st.integers(1, 400), max_size=200)), min_size=1, max_size=6),
       st.integers(1, 40))
@settings(max_examples=80, deadline=None)
def test_joint_ends_of_any_offsets(parts, lane):
    a, b, first_a, first_b, base = [], [], [], [], 0
    for x, y in parts:
        first_a.append(len(a))
        first_b.append(len(b))
        a += [base + e for e in sorted(x | {401})]
        b += [base + e for e in sorted(y | {401})]
        base += 401
    mark_a, mark_b = alignment.joint_ends(np.array(a), np.array(b), np.array(first_a), np.array(first_b), lane)
    joint = set(a) & set(b)
    assert mark_a.tolist() == [e in joint for e in a] and mark_b.tolist() == [e in joint for e in b]


@pytest.mark.parametrize("run", [mixing.op13, collocations.op12, alignment.op11])
def test_empty_table(empty, run):
    assert run(empty).count() == 0
