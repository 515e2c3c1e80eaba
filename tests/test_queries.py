"""A part of the registered queries against their SQL on the smallest tables, and the registry itself."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [
    "p1_found", "p1_breast_cancer_rows", "p2_found", "p5_found", "points_cust2d", "dedup_label_backfill", "knn_ties", "knn_grid", "knn_metric_correlation", "hamming_knn", "lsh_candidates",
    "radius_count", "snn_edges", "cluster_with_duplicates", "cluster_without_noise", "noise_lof", "nmi", "f_measure", "class_confusion", "dbscan", "hilbert_codes", "partition_voronoi", "stream_assign",
]


def norm(v):
    if v is None or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(list(map(norm, v))) if isinstance(v, (list, tuple)) else str(v)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    assert got == sorted(tuple(norm(r[at.index(c)]) for c in cols) for r in cur.fetchall())
