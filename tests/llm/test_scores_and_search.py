import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import hilbert, licences, quality, spann
from logsift.llm.common import table

from .conftest import ODD

LABELS = "doc_id long, quality int, toxic int"


# -- quality ------------------------------------------------------------------

def auc(y, s):
    order = s.rank()
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    return (order[y == 1].sum() - good * (good + 1) / 2) / (good * bad)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    labels = table(spark, path, "labels")
    got = quality.quality_scores(table(spark, path, "documents"), labels).toPandas()
    assert got.doc_id.is_unique and len(got) == 10_000
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(both.quality, both.score) > 0.98
    assert both[both.quality == 1].predicted.mean() > 0.97 and both[both.quality == 0].predicted.mean() < 0.1


def test_held_out_labels_are_not_learned(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_scores_look_at_the_text_alone(spark, frame, small):
    docs = table(spark, small, "documents")
    other = docs.select((F.col("doc_id")).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit(None).cast("string").alias("source"),
                        F.lit(0).alias("n_chars"))
    labels = table(spark, small, "labels")
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(x, labels).collect()} for x in (docs, other))
    assert a == b


def test_odd_documents_and_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (8, 1, 0), (8, 1, 1), (9, None, 0), (None, 1, 0), (14, 0, 0), (999, 0, 1)], LABELS)
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    six = [r.score for r in rows if r.doc_id == 6]
    assert six[0] == six[1]
    unlabelled = quality.quality_scores(odd, spark.createDataFrame([], LABELS)).collect()
    assert all(r.predicted == 1 for r in unlabelled)
    assert quality.quality_scores(empty, labels).count() == 0


def test_gam_tables_fit_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_gam(x, y, rounds=20, n_pairs=2)
    assert (0, 1) in {p[:2] for p in model.pairs}
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    alone = quality.fit_gam(x, y, rounds=20, n_pairs=0)
    assert ((alone.score(x) > 0.5) == y).mean() < 0.7


# -- Hilbert ------------------------------------------------------------------

@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_hilbert_curve_walks_to_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert.hilbert_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("which", ["odd", "table"])
def test_shards(spark, odd, small, which):
    docs = odd if which == "odd" else table(spark, small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = hilbert.op2(docs).collect()
    size = lambda t: len((t or "").encode())
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=key) == sorted(
        ((d, size(t) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=key)
    shards = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
        shards.setdefault(r.shard, []).append(r.slot)
    counts = [len(shards.get(i, [])) for i in range(24)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_shards_prune_on_several_dimensions(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    placed = hilbert.op2(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    by = placed.groupby("shard").agg(langs=("lang", "nunique"), lo=("doc_id", "min"), hi=("doc_id", "max"), a=("size", "min"), b=("size", "max"))
    assert by.langs.mean() < 3 and ((by.hi - by.lo) < 5_500).mean() > 0.3 and (by.a > 1000).mean() > 0.3


def test_shards_prune_on_sources_with_one_prefix(frame):
    rows = [(i, "x" * 50, "en", f"https://host{i * 7 % 8}.example/" if i % 9 else None, 50) for i in range(800)]
    docs = frame(rows)
    codes = {(r.source, r.code) for r in docs.select("source", hilbert.as_number(docs, "source").alias("code")).collect()}
    assert len(codes) == len({c for _, c in codes}) == 9
    assert [s for s, _ in sorted(codes, key=lambda x: x[1])] == [None] + [f"https://host{i}.example/" for i in range(8)]
    placed = hilbert.op2(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert placed.groupby("shard").source.nunique().mean() < 3


def test_shards_of_an_empty_table(empty):
    assert hilbert.op2(empty).count() == 0


def test_written_shards(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    hilbert.write_shards(odd, path, shards=4)
    back = spark.read.parquet(path)
    assert back.count() == len(ODD) and set(odd.columns) <= set(back.columns) and back.select("shard").distinct().count() == 4


# -- nearest neighbours ---------------------------------------------------------

def brute(vectors, k):
    ids = np.array([i for i, _ in vectors])
    v = np.array([x for _, x in vectors], float)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = (v * v[ids == q]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("path", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, path):
    vectors = table(spark, path, "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    got = found(spann.op6(vectors))
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    scores = {(q, i): s for q, near in want.items() for i, s in near}
    assert all(abs(s - scores[q, i]) < 1e-12 for q, near in got.items() for i, s in near if (q, i) in scores)
    assert all(near == sorted(near, key=lambda x: (-x[1], x[0])) for near in got.values())


def test_small_tiles_give_the_same(spark, frame, monkeypatch):
    """Many lists in many tiles; one vector fills a fifth of the rows, in lists that are dealt to several tiles."""
    monkeypatch.setattr(spann, "LIST_ROWS", 40)
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    rows = [(i, rows[7][1] if i % 5 == 0 and i < 400 else v) for i, v in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    every = F.col("vec_id") % 20 == 0
    a = found(spann.nearest(vectors, every))
    assert found(spann.nearest(vectors, every, tile_rows=16, tile_queries=3)) == a
    want = brute(rows, 20)
    assert all([i for i, _ in a[q]] == [i for i, _ in want[q]] for q in a if q < 400)      # ties go to the smaller id
    assert np.mean([len({i for i, _ in a[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("kind", ["binary", "one-hot"])
def test_ties_of_different_vectors_go_to_the_smaller_id(frame, kind):
    """Whole levels of scores tie exactly; every vector is its own."""
    ids = np.random.default_rng(3).permutation(400)
    rows = ([(int(i), [float(n + 1 >> b & 1) for b in range(9)]) for n, i in enumerate(ids)] if kind == "binary" else
            [(int(i), [float(1 + n // 64) if n % 64 == b else 0.0 for b in range(64)]) for n, i in enumerate(ids)])
    assert found(spann.op6(frame(rows, "vec_id long, embedding array<double>"))) == brute(rows, 20)


def test_odd_vectors(spark, frame):
    from pyspark.sql import types as T
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                         T.StructField("v", T.StringType())])
    good = [(0, [1.0, 0.0], "x"), (20, [0.0, 2.0], None), (3, [1.0, 1.0], "x"), (2, [1.0, 1.0], "x"), (5, [-1.0, 0.5], "x"), (5, [-1.0, 0.5], "x")]
    bad = [(40, None, "x"), (60, [0.0, 0.0], "x"), (7, [float("nan"), 1.0], "x"), (8, [None, 1.0], "x"), (9, [float("inf"), 1.0], "x"),
           (10, [1.0, 2.0, 3.0], "x"), (11, [], "x"), (None, [1.0, 1.0], "x")]
    got = found(spann.op6(frame(good + bad, kind)))
    assert got == {0: [(2, 1.0), (3, 1.0), (20, 0.0), (5, -1.0)], 20: [(2, 2.0), (3, 2.0), (5, 1.0), (0, 0.0)]}
    assert spann.op6(frame([], kind)).count() == 0
    assert spann.op6(frame(bad[:5], kind)).count() == 0


# -- licences -------------------------------------------------------------------

def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(licences.oracle_sql()).fetchall())


def test_licences_against_all_pairs(frame):
    mit = licences.TEMPLATES[6][1]
    rows = [
        (1, "intro\nReleased under the MIT License.\nLICENSED UNDER CC BY-NC 4.0"), (2, "Released  under -- the MIT licence"), (3, None), (4, ""),
        (5, "license"), (6, mit), (7, "\n\n" + mit.replace(" to ", "\nto ") + "\n\nmore"), (8, mit.replace("Software", "Program")),
        (9, " ".join(f"x{i}" for i in range(3000)) + mit), (10, "Licensed under the Apache License, Version 2.0\r\nLicensed under CC BY 4.0."),
        (11, "the of the of the and license licensed under the"), (12, "This work is licensed under the GNU General Public License, version 3"),
        (13, licences.TEMPLATES[2][1].upper()), (14, "Released under the MIT License.\n" * 50),
    ]
    got = licences.licence_matches(frame([(*r, "en", "a", 0) for r in rows])).collect()
    assert sorted((r.doc_id, r.kind, r.unit, r.licence, r.template, r.dice) for r in got) == oracle(rows)
    assert {r.doc_id for r in got} >= {1, 6, 7, 10, 12, 13, 14} and not {r.doc_id for r in got} & {3, 4, 5, 9, 11}


def test_whole_licences_and_bodies(frame):
    """On one line, in comments whose lines are never blank, as clauses without blank lines, and as paragraphs of a body."""
    import textwrap

    from logsift.llm.licence_texts import BODIES
    base = [t for _, t in licences.TEMPLATES]
    mit, bsd = base[6:9], base[11:15]
    gpl = [base[20], base[21], "You should have received a copy of the GNU General Public License along with this program. "
                               "If not, see <http://www.gnu.org/licenses/>."]

    def comment(parts, mark):
        lines = f"\n{mark}\n".join(textwrap.fill(p, 70, initial_indent=mark + " ", subsequent_indent=mark + " ") for p in parts)
        return lines + "\n\ncode = 1"

    clauses = "\n".join(textwrap.fill(f"{i}. {p}", 75) for i, p in enumerate(bsd[1:], 1))
    rows = [(1, " ".join(mit)), (2, "/*\n" + comment(mit, " *")), (3, comment(gpl, "#")), (4, textwrap.fill(bsd[0], 75) + "\n" + clauses), (5, clauses)]
    free = next(t for t in base if "perpetuity" in t and "unencumbered" in t)
    rows.append((6, " ".join(free.split()) + " For more information, please refer to <http://unlicense.org/>"))
    rows += [(10 + i, textwrap.dedent(b)) for i, b in enumerate(BODIES.values())]
    rows += [(20 + i, " ".join(b.split())) for i, b in enumerate(BODIES.values())]
    got = licences.licence_matches(frame([(*r, "en", "a", 0) for r in rows])).collect()
    names = {}
    for r in got:
        names.setdefault(r.doc_id, set()).add(r.licence)
    assert "OTHER DEALINGS" in free and names[6] == {"Unlicense"}
    # the paragraphs of a comment are units, too: those of a GPL header hold for any version
    assert [names.get(i) for i in range(1, 6)] == [{"MIT"}, {"MIT"}, {"GPL-3.0-or-later", "GPL"}, {"BSD-3-Clause"}, {"BSD-3-Clause"}]
    for i, name in enumerate(BODIES):
        assert name in names[10 + i] and names[20 + i] == {name}
    few = [r for r in rows if r[0] < 10 or r[0] in (10, 12, 20, 22)]
    assert sorted((r.doc_id, r.kind, r.unit, r.licence, r.template, r.dice) for r in got if r.doc_id in {i for i, _ in few}) == oracle(few)


def test_a_licence_comment_right_above_code(frame):
    """A whole licence in a comment with code or another comment's paragraph beside it, without a blank line."""
    from logsift.llm.licence_texts import WHOLE
    mit = next(t for name, t in WHOLE if name == "MIT")
    lines = [x.strip() for x in mit.strip().split("\n")]
    code = "\n".join(f"int value_{i} = compute_{i}(input[{i}], scale);" for i in range(60))
    block = "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */\n" + code
    hashes = "\n".join(f"# {x}".rstrip() for x in lines) + "\nimport os\n" + code.replace(";", "")
    slashes = "package main\n" + "\n".join(f"// {x}".rstrip() for x in lines) + "\n" + code
    rows = [(1, block), (2, hashes), (3, slashes), (4, code), (5, "- one\n- two\n\x01\n* three\n# four"),
            (6, "# About this module\n#\n" + hashes + "\n" + code)]
    got = licences.licence_matches(frame([(*r, "en", "a", 0) for r in rows])).collect()
    assert {r.doc_id for r in got if r.licence == "MIT" and r.kind.startswith("comment")} == {1, 2, 3, 6}
    assert not any(r.doc_id in (4, 5) for r in got)
    assert sorted((r.doc_id, r.kind, r.unit, r.licence, r.template, r.dice) for r in got) == oracle(rows)


def test_licences_odd_and_empty(odd, empty):
    got = licences.licence_matches(odd).collect()
    assert [(r.doc_id, r.licence, r.dice) for r in got] == [(19, "MIT", 1.0)]
    assert licences.licence_matches(empty).count() == 0


def test_licence_plan_stays_native(odd):
    plan = licences.licence_matches(odd)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_every_vector_of_an_id_is_a_candidate(spark):
    rows = [(1, [5.0, 0.0]), (1, [-1.0, 0.0]), (1, [4.0, 3.0]), (20, [1.0, 0.0]), (20, [-3.0, 0.0]), (3, [2.0, 1.0]), (4, [0.0, 0.0])]
    rows += [(100 + i, [4.5 - i / 100, 0.0]) for i in range(30)] + [(100 + i, [-9.0, i + 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in spann.op6(df).where("query_id = 20").orderBy("rank").collect()]
    # an id asks with its smallest vector and is found by its best
    best = {}
    for i, v in rows:
        if i != 20 and any(v):
            best[i] = max(best.get(i, -1e9), -3.0 * v[0])
    assert got == [(n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20])]
