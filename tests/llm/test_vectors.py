"""Similar vectors, clusters and subsets against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marchland.llm import groups, similar, varied
from marchland.llm.index import Projected, chi2_quantile, principal, projection, space_for
from marchland.operators import dense
from marchland.operators.components import components
from marchland.operators.tree_knn import Space, Tree

SCHEMA = "g long, id long, a double, b double, extra string, _u string"


def plane(spark, rows):
    return spark.createDataFrame([(g, i, a, b, "x", "clash") for g, i, a, b in rows], SCHEMA)


def random_plane(n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i % 2), i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.random((n, 2)) * 4, 1))]
    return rows + rows[:5]


def brute_near(rows, k, digits=6):
    rows = sorted(set(rows))
    out = {}
    for r in rows:
        others = sorted((round((r[2] - s[2]) ** 2 + (r[3] - s[3]) ** 2, digits), s[1]) for s in rows if s[0] == r[0] and s[1] != r[1])
        out[r[1]] = [i for _, i in others[:k]]
    return out


def vec():
    return [F.col("a"), F.col("b")]


@pytest.mark.parametrize("leaf_rows", [16_384, 20])
def test_similar_equals_brute_force(spark, leaf_rows):
    rows = random_plane()
    got = similar.most_similar(plane(spark, rows), F.col("g"), F.col("id"), vec(), 5, leaf_rows=leaf_rows).collect()
    assert {r["id"]: [e["i"] for e in r["neighbours"]] for r in got} == brute_near(rows, 5)


def test_similar_hot_place_and_dirty_rows(spark):
    rows = [(1, i, 1.0, 1.0) for i in range(60)] + [(1, 100, 1.5, 1.0), (1, 101, 9.0, 9.0), (2, 200, 0.0, 0.0)]
    dirty = [(1, 300, None, 1.0), (1, 301, float("nan"), 1.0), (None, 302, 1.0, 1.0), (1, None, 1.0, 1.0)]
    got = similar.most_similar(plane(spark, rows + dirty), F.col("g"), F.col("id"), vec(), 5).collect()
    found = {r["id"]: [e["i"] for e in r["neighbours"]] for r in got}
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in brute_near(rows, 5).items() if v}
    assert 302 not in found and 300 not in found


def test_similar_empty(spark):
    assert similar.similar_pairs(similar.most_similar(plane(spark, []), F.col("g"), F.col("id"), vec())).count() == 0


def test_projected_search_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (900, 20)).astype(float)
    df = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(x)], "g long, id long, " + ", ".join(f"v{j} double" for j in range(20)))
    got = similar.most_similar(df, F.col("g"), F.col("id"), [F.col(f"v{j}") for j in range(20)], 5, confidence=0.95, leaf_rows=200).collect()
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    right = total = 0
    for r in got:
        want = sorted((d2[r["id"], j], j) for j in range(len(x)) if j != r["id"])[:5]
        right += len({j for _, j in want} & {e["i"] for e in r["neighbours"]})
        total += 5
    assert total == 4500 and right / total >= 0.9


def test_chi_square():
    assert abs(chi2_quantile(0.95, 6) - 12.5916) < 1e-3 and abs(chi2_quantile(0.99, 1) - 6.6349) < 1e-3
    assert projection(20, 6).shape == (20, 6) and type(space_for(None, 2, 0.9)) is Space


def test_most_pairs_are_not_verified(spark):
    rng = np.random.default_rng(12)
    kinds = rng.integers(0, 3, (8, 30))
    x = kinds[rng.integers(0, 8, 3000)] + (rng.random((3000, 30)) < 0.3) * rng.integers(-1, 2, (3000, 30)) + rng.random((3000, 1))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "_v array<double>")
    axes = principal(rows, 30, 8)
    assert np.allclose(axes.T @ axes, np.eye(8))
    leaves = Projected(axes, 0.97).leaves(x, np.arange(3000))
    r, _, at = leaves.search(x, np.arange(3000), 5)
    d2 = ((x[:500, None] - x[None]) ** 2).sum(axis=2)
    d2[np.arange(500), np.arange(500)] = np.inf
    want = np.argsort(d2, axis=1)[:, :5]
    hits = sum(len(set(want[i]) & set(at[r == i])) for i in range(500))
    assert hits / 2500 >= 0.95 and leaves.verified / 3000**2 < 0.3


def test_tree_descent_finds_the_leaves_near():
    rng = np.random.default_rng(13)
    x = rng.random((5000, 3))
    for parts in (1, 3):
        tree = Tree(x[:800], 40, parts)
        leaf = tree.leaf(x, np.arange(5000))
        assert len(np.unique(leaf)) == 40 * parts
        q, limit = x[:50], np.full(50, 0.04)
        r, at = tree.near(q, limit)
        assert (np.diff(r) >= 0).all()
        for i in range(50):
            need = set(leaf[((x - q[i]) ** 2).sum(axis=1) <= 0.04])
            assert need <= set(at[r == i]) and len(at[r == i]) < 40 * parts


def brute_groups(rows, near, least=3):
    rows = sorted(set(rows))
    up = {r[1]: r[1] for r in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in rows:
        for s in rows:
            if r[0] == s[0] and r[1] < s[1] and near(r, s):
                a, b = root(r[1]), root(s[1])
                up[max(a, b)] = min(a, b)
    sets = {}
    for r in rows:
        sets.setdefault(root(r[1]), []).append(r[1])
    return {(f, m) for f, ms in sets.items() if len(ms) >= least for m in ms if m != f}


def test_clusters_of_points(spark):
    rows = random_plane(400, 1)
    got = groups.similarity_clusters(plane(spark, rows), F.col("g"), F.col("id"), vec(), 0, 0.255**2)
    assert {tuple(r) for r in got.collect()} == brute_groups(rows, lambda r, s: round((r[2] - s[2]) ** 2 + (r[3] - s[3]) ** 2, 6) <= 0.065025)


def test_clusters_empty_and_copies(spark):
    assert groups.similarity_clusters(plane(spark, []), F.col("g"), F.col("id"), vec(), 0, 1.0).count() == 0
    rows = [(1, i, 2.0, 2.0) for i in (5, 6, 7)] + [(1, 8, None, 2.0)]
    assert {tuple(r) for r in groups.similarity_clusters(plane(spark, rows), F.col("g"), F.col("id"), vec(), 0, 1.0).collect()} == {(5, 6), (5, 7)}


def records(seed, n=240, f=8):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 4, (40, f))
    x = base[rng.integers(0, 40, n)]
    for row in x:
        for j in rng.integers(0, f, rng.integers(0, 4)):
            row[j] = rng.integers(0, 4)
    return x.astype(float), np.round(rng.random(n) * 2, 2)


@pytest.mark.parametrize("hot", [groups.HOT_BUCKET, 7])
def test_clusters_of_records(spark, hot):
    x, age = records(2)
    f = x.shape[1]
    df = spark.createDataFrame([(i % 3, i, *map(float, v), float(a)) for i, (v, a) in enumerate(zip(x, age))], "g long, id long, " + ", ".join(f"v{j} double" for j in range(f)) + ", age double")
    cols = [F.col(f"v{j}") for j in range(f)] + [F.col("age")]
    if hot != groups.HOT_BUCKET:
        nodes = df.groupBy(F.col("g").alias("_g"), F.array(*cols).alias("_v")).agg(F.min("id").alias("_u"), F.count(F.lit(1)).alias("n"))
        a, b = ({tuple(r) for r in groups.attribute_degrees(nodes, f, 4.5, h).collect()} for h in (hot, groups.HOT_BUCKET))
        assert a == b and len(a) > 50
        whole = {tuple(r) for r in components(groups.minhash_links(nodes, f, 4.5, hot), "v", "u").collect()}
        assert whole == {tuple(r) for r in components(groups.minhash_links(nodes, f, 4.5), "v", "u").collect()}
        alone = nodes.withColumn("_c", F.col("_u"))
        some = [{tuple(r) for r in components(groups.block_rest(alone, f, 4.5, h), "v", "u").collect()} for h in (hot, groups.HOT_BUCKET)]
        assert some[0] == some[1] and whole and {i for i, _ in whole} <= {i for i, _ in some[0]}
        return
    got = groups.similarity_clusters(df, F.col("g"), F.col("id"), cols, f, 4.5)
    rows = [(i % 3, i, i, 0) for i in range(len(x))]
    near = lambda r, s: round(((x[r[1]] - x[s[1]]) ** 2).sum() + (age[r[1]] - age[s[1]]) ** 2, 6) <= 4.5
    assert {tuple(r) for r in got.collect()} == brute_groups(rows, near)


def test_described_clusters_cover_all_members(spark):
    rows = random_plane(300, 5)
    got = groups.describe_clusters(plane(spark, rows), F.col("g"), F.col("id"), vec(), 0, 0.255**2).collect()
    members = brute_groups(rows, lambda r, s: round((r[2] - s[2]) ** 2 + (r[3] - s[3]) ** 2, 6) <= 0.065025)
    sizes = {}
    for f, _ in members:
        sizes[f] = sizes.get(f, 1) + 1
    parts = {}
    for r in got:
        parts[r["first_id"]] = parts.get(r["first_id"], 0) + r["size"]
        assert r["medoid_id"] is not None and 1 <= len(r["typical"]) <= 3
    assert parts == sizes


def test_loose_clusters_are_split_by_all_members(spark):
    rng = np.random.default_rng(3)
    crowd = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.02, (80, 2)))]
    chain = [(1, 100 + i, 0.1 * i, 0.0) for i in range(1, 400)]
    rows = crowd + chain
    got = groups.describe_clusters(plane(spark, rows), F.col("g"), F.col("id"), vec(), 0, 0.255**2).collect()
    xy, ids = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    d2 = ((xy[:, None] - xy) ** 2).sum(axis=2)
    deg = (np.round(d2, 6) <= 0.065025).sum(axis=1)
    medoids = []
    for k in np.lexsort((ids, -deg)):
        if len(medoids) < 8 and all(d2[k, m] > 9 * 0.255**2 for m in medoids):
            medoids.append(k)
    assert len(medoids) == 8 and len(set(ids[medoids].tolist()) - {r["medoid_id"] for r in got}) <= 2 and all(r["loose"] for r in got)
    assert sum(r["size"] for r in got) == len(rows) and len(got) > 12
    degree = dict(zip(ids.tolist(), deg.tolist()))
    assert all(r["size"] < 50 or max(degree[i] for i in r["typical"]) >= 0.2 * r["size"] for r in got)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(21)
    a = rng.integers(0, 4, (1, 33))
    b = np.repeat(a, 400, axis=0)
    for i in range(400):
        b[i, rng.choice(33, 4, replace=False)] += 4
    keys = groups.attribute_signatures(np.zeros(401), np.concatenate([a, b]), bands=200, rows=1)
    assert abs((keys[1:] == keys[0]).mean() - 29 / 37) < 0.03
    jaccard = groups.disc_jaccard()
    keys = groups.point_signatures(np.zeros(2), np.array([5, 7]), np.array([5, 6]), bands=4000)
    assert abs((keys[0] == keys[1]).mean() - jaccard[2, 1]) < 0.03 and jaccard[0, 0] == 1


def test_points_and_hot_buckets(spark):
    rows = random_plane(500, 9)
    nodes = plane(spark, rows).groupBy(F.col("g").alias("_g"), F.array("a", "b").alias("_v")).agg(F.min("id").alias("_u"), F.count(F.lit(1)).alias("n"))
    a, b = ({tuple(r) for r in components(groups.point_links(nodes, 0.255, hot), "v", "u").collect()} for hot in (9, 10**6))
    assert a == b and a
    alone = nodes.withColumn("_c", F.col("_u"))
    a, b = ({tuple(r) for r in components(groups.cell_rest(alone, 0.255, hot), "v", "u").collect()} for hot in (9, 10**6))
    assert a == b and a


def test_disc_counts():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.2, 900), rng.random(500) * 5, np.full(20, 1.0)])
    y = np.concatenate([rng.normal(0, 0.2, 900), rng.random(500) * 5 - 9, np.full(20, 1.0)])
    bucket, n = rng.integers(0, 2, len(x)), rng.integers(1, 4, len(x))
    near = (np.round((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2, 6) <= 0.065025) & (bucket[:, None] == bucket)
    assert (dense.disc_counts(bucket, x, y, n, 0.255, 0.065025) == near @ n).all()


def test_point_degrees_are_links(spark):
    rows = list(dict.fromkeys(random_plane(500, 6)))
    nodes = plane(spark, rows).groupBy(F.col("g").alias("_g"), F.array("a", "b").alias("_v")).agg(F.min("id").alias("_u"), F.count(F.lit(1)).alias("n"))
    got = {r["_u"]: r["links"] for r in groups.point_degrees(nodes, 0.255).collect()}
    first = {}
    for g, i, a, b in rows:
        first.setdefault((g, a, b), i)
    want = {u: sum(h == g and (c, d) != (a, b) and round((a - c) ** 2 + (b - d) ** 2, 6) <= 0.065025 for h, _, c, d in rows) for (g, a, b), u in first.items()}
    assert got == want


def test_record_links_count_copies(spark):
    vs = [[0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 1], [3, 3, 3, 3, 3, 3]]
    nodes = spark.createDataFrame([(1, [float(e) for e in v], i, n) for i, (v, n) in enumerate(zip(vs, (1, 5, 2)))], "_g long, _v array<double>, _u long, n long")
    got = {r["_u"]: r["links"] for r in groups.attribute_degrees(nodes, 6, 1.5).collect()}
    assert got == {0: 5, 1: 1}


@pytest.mark.parametrize("leaf_rows", [2048, 30])
def test_subset_musts(spark, leaf_rows):
    rng = np.random.default_rng(8)
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.random((250, 2)) * 30, 1))]
    got = varied.varied_subset(plane(spark, rows), F.col("g"), F.col("id"), vec(), 1.005**2, 40, leaf_rows).collect()
    lone = {r[1] for r in rows if not any(s[1] != r[1] and round((r[2] - s[2]) ** 2 + (r[3] - s[3]) ** 2, 6) <= 1.010025 for s in rows)}
    assert {r["id"] for r in got if r["must"]} == lone
    assert len(got) >= 40 and len({r["id"] for r in got}) == len(got)


@pytest.mark.parametrize("leaf_rows", [2048, 40])
def test_subset_reaches_every_record(spark, leaf_rows):
    rng = np.random.default_rng(10)
    lone = [(1, i, 100.0 + 5 * i, 0.0) for i in range(30)]
    crowd = [(1, 100 + i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.random((600, 2)) * 12, 1))]
    rows = lone + crowd
    got = varied.varied_subset(plane(spark, rows), F.col("g"), F.col("id"), vec(), 1.005**2, 20, leaf_rows).collect()
    at = {r[1]: r[2:] for r in rows}
    assert {r[1] for r in lone} <= {r["id"] for r in got if r["must"]} and len({r["id"] for r in got}) == len(got) < 300
    assert all(any(round((at[r["id"]][0] - x) ** 2 + (at[r["id"]][1] - y) ** 2, 6) <= 1.010025 for r in got) for _, _, x, y in rows)
    assert sum(r["stands_for"] for r in got) == len(rows)
    assert sum(not r["must"] for r in got) >= 20


def test_subset_musts_of_a_group_in_parts_without_a_tree(spark):
    rng = np.random.default_rng(9)
    crowd = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((2 * varied.LEAF_ROWS + 400, 2)))]
    rows = [(1, -2, 900.0, 0.0), (1, -1, 500.0, 0.0), *crowd, (1, len(crowd), 500.5, 0.0)]
    got = varied.varied_subset(plane(spark, rows), F.col("g"), F.col("id"), vec(), 1.005**2, 10, 1_000_000).collect()
    assert {r["id"] for r in got if r["must"]} == {-2}


def test_subset_of_many_lone_pairs_ends(spark):
    rows = [(1, 2 * i + j, 10.0 * i + 0.1 * j, 0.0) for i in range(5000) for j in range(2)]
    began = time.time()
    got = varied.varied_subset(plane(spark, rows), F.col("g"), F.col("id"), vec(), 1.0, 50).collect()
    assert 5000 <= len(got) < 5100 and not any(r["must"] for r in got) and time.time() - began < 120
    few = varied.varied_subset(plane(spark, rows), F.col("g"), F.col("id"), vec(), 1.0, 50, cover=False).collect()
    assert len(few) == 50 and sum(r["stands_for"] for r in few) == 100


def test_subset_small_empty_and_copies(spark):
    assert varied.varied_subset(plane(spark, []), F.col("g"), F.col("id"), vec(), 1.0, 5).count() == 0
    rows = [(1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0), (1, 3, 50.0, 0.0), (2, 4, 0.0, 0.0), (2, 5, None, 0.0)]
    got = {(r["group"], r["id"], r["must"]) for r in varied.varied_subset(plane(spark, rows), F.col("g"), F.col("id"), vec(), 1.0, 2).collect()}
    assert got == {(1, 1, False), (1, 3, True), (2, 4, True)}


def test_lazy_greedy_is_greedy():
    rng = np.random.default_rng(4)
    sim = rng.random((40, 40)).astype(np.float64)
    sim = np.maximum(sim, sim.T)
    w = rng.random(40)
    want, best = [], np.zeros(40)
    for _ in range(6):
        gains = [(w @ np.maximum(0, sim[:, j] - best), -j) for j in range(40)]
        j = -max(gains)[1]
        want.append(j)
        best = np.maximum(best, sim[:, j])
    assert varied.lazy_greedy(sim, w, 6, False) == want
