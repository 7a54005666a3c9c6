import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from logsift.llm import packing, quality, queries, suffix
from logsift.llm.common import stage, table

from .conftest import LONG, ODD
from .test_dedup import expected_groups, linked, plain_fingerprint

SF = "/root/testdata/sf0.001"


def plain_kept(rows, predicted):
    """The texts that reach the last stage, by brute force: {doc_id: text}."""
    rows = [(d, t) for (d, t), p in zip(rows, predicted) if p]
    keepers = {keep for _, keep, _, _ in expected_groups(rows)}
    rows = sorted((d, t) for d, t in rows if d in keepers)
    roots = linked(np.array([plain_fingerprint(t) for _, t in rows], np.uint64), 2)
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    from collections import Counter
    texts = [t.encode() for _, t in rows]
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = {}
    for (d, _), t in zip(rows, texts):
        covered = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                covered[i:i + 200] = [True] * 200
        spans, at = [], 0
        while at < len(t):
            if covered[at]:
                end = at
                while end < len(t) and covered[end]:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out[d] = suffix.cut_text(t, spans).decode()
    return out


def test_pipeline_against_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = plain_kept(rows, [scores[d] for d, _ in rows])
    frames = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        frames = stage(function(spark, frames, SF), "test", 8)
        assert frames.columns == docs.columns, name
    assert {r.doc_id: r.text for r in frames.collect()} == want
    packed = corpus_pipeline.run(spark, SF).collect()
    lengths = {r.doc_id: 0 for r in packed}
    for r in packed:
        lengths[r.doc_id] += r.length
    again = {}
    for r in packing.token_pieces(frames).collect():
        again[r.doc_id] = again.get(r.doc_id, 0) + r.length
    assert lengths == again and lengths.keys() == want.keys()


def test_stages_take_odd_rows(spark, odd, frame, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (14, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    names = ["row", "_row", "runs", "rep", "digest", "fp", "pos", "features", "score", "token"]
    rows = [(i, LONG[:900 + i] if i < 3 else f"text number {i}", "en", "a", 5, *[f"{n}{i}" for n in names]) for i in range(8)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, str(tmp_path)), "test", 8)
        assert docs.columns == [c.split()[0] for c in kind.split(", ")], name
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names)


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(cursor.fetchall())


def test_all_queries_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q.startswith("op")} and "pipeline" in names
    assert set(queries.queries()) <= set(names)


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    from pathlib import Path
    root = Path(entry.__file__).parent
    shutil.copytree(root / "logsift", tmp_path / "logsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "oracles.py"):
        shutil.copy(root / f, tmp_path / f)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op1') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})


def test_odd_table_has_what_it_should():
    assert len(ODD) == 22 and any(r[0] is None for r in ODD) and max(len(r[1] or "") for r in ODD) > 100_000
