"""Clustering operators on small cases, against brute force and by their symmetries."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marchland.operators import baselines, centrality, cluster, connect, evaluate, graph, neighbors, noise, prep
from marchland.operators.components import components
from marchland.functions.distances import METRICS, distance


def frame(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")


def moons(n=80, seed=0):
    rng = np.random.default_rng(seed)
    a = np.linspace(0, math.pi, n)
    up = np.stack([np.cos(a), np.sin(a)], axis=1)
    down = np.stack([4 + np.cos(a), 4 - np.sin(a)], axis=1)
    return np.round(np.concatenate([up, down]) + rng.normal(0, 0.08, (2 * n, 2)), 4)


def brute_knn(xy, k):
    out = set()
    for i, p in enumerate(xy):
        best = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, j) for j, q in enumerate(xy) if j != i)[:k]
        out |= {(i, r + 1, j) for r, (_, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("leaf_rows", [16_384, 25])
def test_knn_with_ties_and_copies(spark, leaf_rows):
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.integers(0, 8, (150, 2)), np.full((20, 2), 3)])
    got = {(r["id"], r["rank"], r["nbr"]) for r in neighbors.knn(frame(spark, xy), 4, leaf_rows=leaf_rows).collect()}
    assert got == brute_knn(xy, 4)


def test_knn_grid_equals_knn(spark):
    df = frame(spark, np.concatenate([moons(), [[90.0, 90.0]]]))
    key = lambda t: {(r["id"], r["rank"], r["nbr"]) for r in t.collect()}
    assert key(neighbors.knn_grid(df, 6)) == key(neighbors.knn(df, 6))


@pytest.mark.parametrize("leaf_rows", [16_384, 10])
def test_nearest_in(spark, leaf_rows):
    rng = np.random.default_rng(2)
    a, b = rng.random((60, 2)), rng.random((40, 2))
    base = frame(spark, b).withColumn("id", F.col("id") + 1000)
    got = {(r["id"], r["rank"], r["nbr"]) for r in neighbors.nearest_in(frame(spark, a), base, 3, leaf_rows=leaf_rows).collect()}
    want = {(i, r + 1, j + 1000) for i, p in enumerate(a) for r, (_, j) in enumerate(sorted((((p - q) ** 2).sum(), j) for j, q in enumerate(b))[:3])}
    assert got == want


def test_metric_expressions(spark):
    a, b = [1.0, 2.0, 0.0, 4.0], [2.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    inverse = np.linalg.inv(np.diag([1.0, 2, 3, 4]) + 0.1).tolist()
    diff = np.array(a) - b
    rank = lambda v: np.array([sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v])
    want = {
        "cityblock": 6.0, "chebychev": 3.0, "euclidean": math.sqrt(14), "squared_euclidean": 14.0, "hamming": 0.75, "jaccard": 1.0,
        "minkowski": 36 ** (1 / 3), "cosine": 1 - 6 / math.sqrt(21 * 5), "correlation": 1 - np.corrcoef(a, b)[0, 1], "spearman": 1 - np.corrcoef(rank(a), rank(b))[0, 1],
        "seuclidean": math.sqrt((diff**2 / [1, 2, 3, 4]).sum()), "mahalanobis": math.sqrt(diff @ np.array(inverse) @ diff),
    }
    options = {"seuclidean": {"variances": [1, 2, 3, 4]}, "mahalanobis": {"inverse_covariance": inverse}}
    for name, value in want.items():
        got = df.select(distance(name, F.col("a"), F.col("b"), **options.get(name, {})).alias("d")).first()["d"]
        assert got == pytest.approx(value), name
    assert set(want) | {"hamming_bits"} == set(METRICS)


def test_angles_on_axes_and_dcm(spark):
    df = frame(spark, [(0, 0), (1, 0), (0, 1), (-1, 0), (0, -1)])
    edges = neighbors.knn(df, 4)
    got = {r["nbr"]: r["angle"] for r in centrality.neighbour_angles(edges, df).where("id = 0").collect()}
    assert got == pytest.approx({1: 0, 2: math.pi / 2, 3: math.pi, 4: 1.5 * math.pi})
    score = {r["id"]: r["dcm"] for r in centrality.dcm_2d(centrality.neighbour_angles(edges, df)).collect()}
    assert score[0] == pytest.approx(0) and score[1] > 0.3


def test_threshold_ranks():
    assert centrality.threshold_rank(100, 0.7) == 70 and centrality.threshold_rank(10, 0.75, "next") == 9 and centrality.threshold_rank(10, 0.99, "next") == 10
    with pytest.raises(ValueError):
        centrality.threshold_rank(10, 1.0)


def test_rank_value(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.random(400), np.full(50, 0.5)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for r in (1, 7, 225, 450):
        assert prep.rank_value(df, "v", r, bins=8, few=5) == np.sort(v)[r - 1]


def test_clusters_of_two_shapes_are_invariant(spark):
    xy = moons()
    truth = [0] * 80 + [1] * 80
    a = math.radians(30)
    turned = xy @ np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]) * 3 + 7
    for pts in (xy, turned):
        got = {r["id"]: r["cluster"] for r in cluster.cluster(frame(spark, pts), 8, 0.6).collect()}
        assert set(got) == set(range(160))
        for c in set(got.values()):
            assert len({truth[i] for i in got if got[i] == c}) == 1


def test_cluster_rejects_and_copies(spark):
    with pytest.raises(ValueError):
        cluster.cluster(frame(spark, [(1, 1)] * 9), 3, 0.5)
    xy = moons()
    got = {r["id"]: r["cluster"] for r in cluster.cluster(frame(spark, np.concatenate([xy, xy[:10]])), 8, 0.6).collect()}
    assert all(got[i] == got[160 + i] for i in range(10))


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(x), float(y), float(r)) for i, (x, y, r) in enumerate(np.column_stack([rng.random((200, 2)) * 20, np.exp(rng.normal(-1, 1.3, 200))]))]
    got = {tuple(r) for r in connect.overlap_edges(spark.createDataFrame(rows + [(900, 50.0, 50.0, 0.0), (901, 50.0, 50.0, 0.0)], "id long, x double, y double, reach double"), ["x", "y"]).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= a[3] + b[3]} | {(900, 901)}
    assert got == want


def test_single_pass_leaves_a_chain_in_two(spark):
    balls = spark.createDataFrame([(1, 1.0), (2, 1.0), (4, 1.0), (3, 1.0)], "id long, reach double")
    edges = spark.createDataFrame([(1, 3), (3, 4), (2, 4)], "src long, dst long")  # 1 - 3 - 4 - 2
    got = {r["id"]: r["component"] for r in connect.single_pass(balls, edges).collect()}
    assert got[1] == got[3] and got[2] == got[4] and got[1] != got[2]
    assert {r["component"] for r in components(edges).collect()} == {1}


@pytest.mark.parametrize("d", [3, 4])
def test_hull_facets_equal_brute_force(d):
    rng = np.random.default_rng(d)
    for _ in range(5):
        u = rng.normal(size=(9, d))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        assert set(centrality.sphere_facets(u)) == set(centrality.facets_by_force(u))


def test_hull_of_flat_directions_fails_softly():
    flat = np.array([[1, 0, 0], [0, 1, 0], [-1, 0, 0], [0, -1, 0], [1, 1, 0]], float)
    assert centrality.hull_dcm(flat) == 1.0 and centrality.hull_dcm(flat, fail_value=0.0) == 0.0


def test_noise_finds_the_far_point(spark):
    rng = np.random.default_rng(7)
    df = frame(spark, np.concatenate([rng.random((60, 2)), [[9.0, 9.0]]]))
    edges = neighbors.knn(df, 5)
    for t in (noise.lof(edges, 0.5), noise.rknn(edges, df, 0.05), noise.idm(edges, 0.1)):
        assert t.where("is_noise and id = 60").count() == 1 and t.where("is_noise").count() < 8
    got = {r["id"]: r["cluster"] for r in cluster.cluster_without_noise(df, noise.lof(edges, 0.5).where("is_noise"), 6, 0.6).collect()}
    assert got[60] == 0 and max(got.values()) >= 1


def labels(spark, t, p):
    return evaluate.contingency(spark.createDataFrame(list(zip(t, p)), "t int, p int"), "t", "p")


def test_metrics_by_hand(spark):
    table = labels(spark, [1, 1, 1, 2, 2, None], [1, 1, 2, 2, 2, 1])
    assert tuple(evaluate.pair_counts(table).first()) == (2, 2, 2, 4)
    m = evaluate.pair_metrics(table).first()
    assert m["rand"] == pytest.approx(0.6) and m["ari"] == pytest.approx(1 / 6) and m["jaccard"] == pytest.approx(1 / 3) and m["f_measure"] == pytest.approx(0.5)
    assert tuple(evaluate.purity(table).first()) == pytest.approx((0.8, 0.8))
    same = labels(spark, [0, 4, 4, 9], [7, 1, 1, 3])
    assert evaluate.pair_metrics(same).first()["ari"] == 1 and evaluate.nmi(same).first()["nmi"] == pytest.approx(1)
    assert evaluate.pair_metrics(labels(spark, [1], [1])).first()["ari"] == 1 and evaluate.nmi(labels(spark, [], [])).first()["nmi"] is None


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3)])
def test_assignment_equals_permutations(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(10):
        gain = rng.integers(0, 20, shape).astype(float)
        match = evaluate.assignment(gain)
        got = sum(gain[i, j] for i, j in enumerate(match) if j >= 0)
        wide = gain if shape[0] <= shape[1] else gain.T
        assert got == max(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
        assert len({j for j in match if j >= 0}) == min(shape)


def test_principal_components(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(100, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    scores, load, var = prep.principal_components(df, "v", 2)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert var == pytest.approx(values[:2])
    got = np.array([r["pc"] for r in scores.orderBy("id").collect()])
    assert got == pytest.approx((x - x.mean(axis=0)) @ load)
    assert prep.principal_components(df, "v", 0.999)[1].shape[1] <= 5


def test_dense_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v long").repartition(7)
    got = {r["v"]: r["n"] for r in prep.dense_numbers(df, "v", "n").collect()}
    assert got == {v: v + 1 for v in range(101)}


def test_dbscan_and_vote(spark):
    df = frame(spark, [(0, 0), (0.1, 0), (0.2, 0), (0.45, 0), (5, 5), (5.1, 5), (5.2, 5), (9, 9)])
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in baselines.dbscan(df, 0.26, 3).collect()}
    assert got[0][0] == got[3][0] == 1 and got[5] == (2, True) and got[7] == (0, False) and not got[3][1]
    marked = df.where("id < 7").withColumn("l", F.when(F.col("id") < 4, "a").otherwise("b"))
    vote = baselines.assign_by_vote(frame(spark, [(4.9, 5.0)]).withColumn("id", F.lit(50)), marked, "l", 3).collect()
    assert [(r["id"], r["l"]) for r in vote] == [(50, "b")]


def test_fuzzy_graph(spark):
    df = frame(spark, moons(30))
    edges = neighbors.knn(df, 8)
    widths = graph.bandwidths(edges, 8)
    total = graph.memberships(edges, widths).groupBy("src").agg(F.sum("w").alias("w")).collect()
    assert all(r["w"] == pytest.approx(3.0, abs=1e-3) for r in total)
    g = {(r["src"], r["dst"]): r["w"] for r in graph.fuzzy_graph(edges, 8).collect()}
    assert all(g[(b, a)] == pytest.approx(w) and 0 < w <= 1 for (a, b), w in g.items())
    a, b = graph.fit_curve(1.0, 0.1)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.02)


def test_local_scores():
    assert centrality.local_dimensions(64, 10) == 3 and centrality.local_dimensions(64, 2) == 2
    even = np.array([[0, 0], [1, 0], [0, 1], [-1, 0], [0, -1]], float)
    assert centrality.local_dcm(even, 2) == pytest.approx(0)
    cube = np.array([[x, y, z] for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)], float)
    rng = np.random.default_rng(0)
    units = rng.normal(size=(30, 3))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    assert centrality.facet_angles(units).sum() == pytest.approx(4 * math.pi)
    cloud = rng.normal(size=(12, 6))
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    assert centrality.local_dcm(cloud, 3) == pytest.approx(centrality.local_dcm(cloud @ turn * 4 + 1, 3))
    assert centrality.local_dcm(np.concatenate([[[0.0, 0, 0]], cube * 0]), 3) == 1.0
