"""Samples, ranges, embedded clusters, approximate searches, graphs, bins and geometry texts; hull volumes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marchland.functions import geometry
from marchland.operators import centrality, cluster, communities, evaluate, graph, neighbors, partitioning, prep


def grid(spark, n=200):
    return spark.range(n).select("id", (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))


def test_samples_and_ranges(spark):
    p = grid(spark)
    a, b = (sorted(r["id"] for r in prep.sample_rows(f, 30).collect()) for f in (p, p.repartition(7)))
    assert a == b and len(set(a)) == 30 and prep.sample_rows(p, 999).count() == 200
    assert [r["id"] for r in prep.row_range(p, ["x", "y"], 11, 3).orderBy("x", "y").collect()] == [1, 21, 41]
    assert prep.row_range(p, "id", 500, 5).count() == 0 and prep.sample_rows(p.limit(0), 5).count() == 0


def test_approximate_searches(spark):
    rng = np.random.default_rng(1)
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.random((600, 2)))], "id long, x double, y double")
    exact = neighbors.knn(p, 5)
    few = neighbors.knn_forest(p, 5, trees=2, leaf_rows=60)
    assert neighbors.recall(few, exact).first()[0] > 0.85
    assert neighbors.recall(neighbors.knn_descent(p, few, 5), exact).first()[0] > 0.97
    crowd = p.unionByName(p.limit(30).select((F.col("id") + 1000).alias("id"), "x", "y"))
    got, want = (neighbors.recall(f, neighbors.knn(crowd, 5)).first()[0] for f in (neighbors.knn_grid(crowd, 5), neighbors.knn(crowd, 5)))
    assert got == want == 1.0


@pytest.mark.parametrize("k", [3, 7])
def test_grid_search_of_uneven_points(spark, k):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.normal(0, 0.001, (300, 2)), rng.random((100, 2)) * 100, np.zeros((40, 2)), [[1e4, 1e4]]])
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xy)], "id long, x double, y double")
    assert {tuple(r) for r in neighbors.knn_grid(p, k).select("id", "rank", "nbr").collect()} == {tuple(r) for r in neighbors.knn(p, k).select("id", "rank", "nbr").collect()}
    assert neighbors.knn_grid(p.limit(0), k).count() == 0 and neighbors.knn_grid(p.limit(2), k).count() == 2


def test_graphs(spark):
    a = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.0)], "src long, dst long, w double")
    b = spark.createDataFrame([(1, 2, 0.4), (4, 1, 0.2)], "src long, dst long, w double")
    got = {(r["src"], r["dst"]): r["w"] for r in graph.intersect_graphs(a, b).collect()}
    assert got == pytest.approx({(1, 2): 0.2, (2, 3): 0.1, (4, 1): 0.05})
    assert {(r["src"], r["dst"]): r["w"] for r in graph.reset_local_connectivity(a).collect()} == {(1, 2): 1.0, (2, 1): 1.0, (2, 3): 1.0, (3, 2): 1.0}
    with pytest.raises(ValueError):
        graph.intersect_graphs(a, b, 1.0)


def test_bins_and_matches(spark):
    binned = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 3)], "s string, bin long")
    assert [tuple(r) for r in partitioning.bin_overlap(binned, "s").collect()] == [("a", "b", pytest.approx(0.4))]
    assert partitioning.normality(binned.limit(0), "bin", 0, 4, 4).first()[0] is None
    table = spark.createDataFrame([("x", 1, 8), ("x", 2, 2), ("y", 2, 5)], "true_label string, pred_label long, n long")
    assert {r["true_label"]: r["pred_label"] for r in evaluate.subset_match(table).collect()} == {"x": 1, "y": 2}


def test_geometry_texts(spark):
    texts = ["POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "multipoint(1 2, 3 4)", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "POINT EMPTY", "nonsense", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", geometry.read_wkt_parts(F.col("t")).alias("g")).orderBy("i").collect()
    assert [(r["g"]["kind"], [len(p) for p in r["g"]["parts"]]) if r["g"] else None for r in got] == [("POLYGON", [4, 4]), ("MULTIPOINT", [1, 1]), ("MULTIPOLYGON", [4, 4]), None, None, None]
    back = df.where("i = 0").select(geometry.wkt_multi("POLYGON", geometry.read_wkt_parts(F.col("t"))["parts"]).alias("t")).first()["t"]
    assert back == "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 1.0))"


def test_hull_volumes_and_embedding(spark):
    cloud = np.random.default_rng(3).standard_normal((12, 3))
    assert centrality.hull_dcm(cloud, norm=0) == pytest.approx(centrality.hull_dcm(cloud) / 4)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 0.3, 10) + (5 if i % 2 else 0)).tolist()) for i in range(160)]
    got = {r["id"]: r["cluster"] for r in cluster.cluster_embedded(spark.createDataFrame(rows, "id long, v array<double>"), 8, 0.7, "v").collect()}
    assert len(got) == 160 and not {got[i] for i in range(0, 160, 2)} & {got[i] for i in range(1, 160, 2)}


def test_communities(spark):
    rows = [(10 * g + i, 10 * g + j, 1.0) for g in range(4) for i in range(6) for j in range(i)] + [(10 * g, 10 * g + 10, 0.5) for g in range(3)] + [(1, 1, 9.0), (1, None, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    found = communities.communities(edges)
    assert {(r["id"], r["community"]) for r in found.collect()} == {(10 * g + i, 10 * g) for g in range(4) for i in range(6)}
    clean = edges.where("src <> dst")
    q = communities.modularity(clean, found).first()[0]
    assert 0.6 < q < 0.75 and communities.modularity(clean, found.withColumn("community", F.lit(1))).first()[0] == pytest.approx(0.0)
    assert communities.communities(edges.limit(0)).count() == 0
