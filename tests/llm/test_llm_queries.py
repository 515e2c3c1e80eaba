"""The queries with SQL on the smallest tables."""

import glob
import os

import pytest

from marchland.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(queries.ORACLE[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[at.index(c)] for c in cols) for r in cur.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_other_queries_run(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLE)):
        df = queries.QUERIES[name](spark, DATA)
        assert df.columns and df.count() >= 0
