"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["events", "lineitem", "orders"]
# the queries of the log analyses; those of the optional corpus operators are tested beside them
EXTRA = set(entry.llm_queries.queries()) if entry.llm_queries else set()
QUERIES = {name: q for name, q in entry.queries().items() if name not in EXTRA}
ORACLES = {name: q for name, q in entry.oracle_sql().items() if name not in EXTRA}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    cols = sorted(dcols)
    drows = sorted((tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    assert srows == drows


@pytest.mark.parametrize("name", ["ct_local_time", "vpc_parse_lines", "s3_parse_lines", "ct_parse_records",
                                  "ct_console_login_recent", "vpc_night_remote"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        test_query_matches_oracle(spark, con, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
