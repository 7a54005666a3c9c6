import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logsift.llm import exact, simhash, suffix
from logsift.llm.common import table

from .conftest import ODD

KEY = lambda r: tuple((x is None, x) for x in r)


def documents(spark, path):
    return [(r.doc_id, r.text) for r in table(spark, path, "documents").collect()]


# -- exact ------------------------------------------------------------------

def expected_groups(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0D]", "", text or ""), []).append((doc, len(text or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0]))[0]
        out += [(doc, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for doc, _ in members]
    return sorted(out, key=KEY)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_exact_groups(spark, odd, small, which):
    docs, rows = (odd, [r[:2] for r in ODD]) if which == "odd" else (table(spark, small, "documents"), documents(spark, small))
    got = exact.op10(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=KEY) == expected_groups(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})       # one row each, also of repeated rows
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_third_of_all_rows_are_copies(frame):
    rows = [(i, "copy of  one text" if i % 3 == 0 else f"text {i}", "en", "a", 5) for i in range(600)]
    got = exact.op10(frame(rows)).collect()
    assert Counter(r.group_size for r in got) == {200: 200, 1: 400} and sum(r.kept for r in got) == 401


# -- SimHash ----------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, radius):
    """Smallest index reachable, by comparing all pairs."""
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius).tolist():
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["odd", "table"])
def test_simhash(spark, odd, small, which):
    docs, rows = (odd, [r[:2] for r in ODD]) if which == "odd" else (table(spark, small, "documents"), documents(spark, small))
    rows = sorted(rows, key=KEY)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = [(rows[i][0], f"{fps[i]:016x}", rows[root][0]) for i, root in enumerate(linked(np.array(fps, np.uint64), 2))]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op5(docs).collect()]
    assert sorted(got, key=KEY) == sorted(want, key=KEY)


def near(rng, n, radius):
    out = []
    for base in rng.integers(0, 1 << 63, n, dtype=np.uint64).tolist():
        for _ in range(int(rng.integers(1, 30))):
            flips = rng.integers(0, 64, int(rng.integers(0, radius + 2)))
            out.append(base ^ sum({1 << int(b) for b in flips}))
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_bit_sliced_forest(radius):
    fps = near(np.random.default_rng(radius), 30, radius)
    member, root = simhash.forest(fps, radius, np.arange(64))
    want = {int(fps[i]): int(fps[r]) for i, r in enumerate(linked(fps, radius)) if r != i}
    assert dict(zip(member.tolist(), root.tolist())) == want


@pytest.mark.parametrize("chunk", [8, 4096])
def test_links_over_chunks_of_hot_buckets(spark, chunk):
    """Fingerprints that share most bits fill a few buckets; dealing them to chunk pairs loses no link."""
    rng = np.random.default_rng(5)
    fps = np.unique(np.concatenate([near(rng, 10, 2), np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)),
                                    rng.integers(0, 1 << 20, 60, dtype=np.uint64)]))
    edges = simhash.link_fingerprints(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 2, chunk).collect()
    index = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for e in edges:
        a, b = sorted((top(index[e.a]), top(index[e.b])))
        parent[b] = a
    assert [top(i) for i in range(len(fps))] == linked(fps, 2)


# -- suffix array -------------------------------------------------------------

def plain_repeats(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if covered[i] and not (i and covered[i - 1]))
        yield len(t), sum(covered), spans, hashlib.sha256(bytes(c for c, x in zip(t, covered) if not x)).hexdigest()


@pytest.mark.parametrize("which", ["odd", "table"])
def test_suffix_dedup(spark, odd, small, which):
    docs, rows = (odd, [r[:2] for r in ODD]) if which == "odd" else (table(spark, small, "documents"), documents(spark, small))
    want = [(d, *p) for (d, _), p in zip(rows, plain_repeats([(t or "").encode() for _, t in rows], 200))]
    got = [tuple(r) for r in suffix.op3(docs).collect()]
    assert sorted(got, key=KEY) == sorted(want, key=KEY)


def test_suffix_dedup_over_many_small_buckets(spark, frame):
    """Few letters, so tokens are common and stretches differ; buckets of a few rows, so every boundary rule runs."""
    rng = np.random.default_rng(3)
    part = ["".join(rng.choice(list("ab"), 60)) for _ in range(6)]
    rows = [(i, "".join(part[j] for j in rng.integers(0, 6, int(rng.integers(1, 7)))) + "c" * int(rng.integers(0, 70)), "e", "a", 1)
            for i in range(60)]
    want = sorted((r[0], *p) for r, p in zip(rows, plain_repeats([r[1].encode() for r in rows], 40)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sorted(tuple(r) for r in suffix.op3(frame(rows), length=40, lead=12).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=12), st.integers(1, 9))
def test_merged_spans(runs, length):
    covered = {j for a, n in runs for j in range(a, a + n - 1 + length)}
    spans = suffix.merge(np.array([a for a, _ in runs], np.int64), np.array([n for _, n in runs], np.int64), length)
    assert {j for a, b in spans for j in range(a, b)} == covered
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aé漢🙂", max_size=20), st.integers(0, 60), st.integers(0, 60))
def test_cuts_keep_characters_whole(text, a, b):
    raw = text.encode()
    a, b = sorted((min(a, len(raw)), min(b, len(raw))))
    kept = suffix.cut_text(raw, [(a, b)]).decode()
    starts = np.cumsum([0, *(len(c.encode()) for c in text)])
    assert kept == "".join(c for c, s, e in zip(text, starts, starts[1:]) if not (a <= s and e <= b))


def test_long_text_is_scanned_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 30_000, dtype=np.uint8))
    whole = text + b"-" + text[5000:9000]
    monkeypatch.setattr(suffix, "_PIECE", 1000)
    starts = set()
    for b in suffix._suffixes([1], [whole], 200, 64):
        for s, n, back, token in zip(*(b.column(c).to_pylist() for c in ("start", "starts", "back", "token"))):
            assert not starts & set(range(s, s + n)) and 0 <= back - n + 1 and back <= 200 - 64
            starts |= set(range(s, s + n))
    assert starts == set(range(len(whole) - 199))
