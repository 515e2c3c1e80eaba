"""Queries of the clustering operators and what surrounds them, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marchland.functions import geometry
from marchland.functions.distances import distance
from marchland.operators import baselines, centrality, cluster, connect, evaluate, neighbors, noise, prep, sweep
from marchland.operators.components import components
from marchland.plans.load import table
from marchland.plans.points import BITS64, CUST2D, EMB2D, EMB64, PART2D, bits64, cust2d, emb2d, emb3d, emb64, part2d

K, RATIO = 10, 0.7
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# points and preparation -----------------------------------------------------------------------------------------------


@query(f"SELECT * FROM {EMB2D}")
def points_emb2d(spark, d):
    return emb2d(spark, d)


@query(f"SELECT id, x, round(y, 3) AS y FROM {CUST2D}")
def points_cust2d(spark, d):
    return cust2d(spark, d).withColumn("y", F.round("y", 3))


@query(f"SELECT min(id) AS rep_id, x, y, count(*) AS n FROM {PART2D} GROUP BY x, y")
def dedup_points(spark, d):
    return prep.dedup(part2d(spark, d))


@query(f"SELECT id, min(id) OVER (PARTITION BY x, y) % 7 AS label FROM {PART2D}")
def dedup_label_backfill(spark, d):
    p = part2d(spark, d)
    labelled = prep.dedup(p).select(F.col("rep_id").alias("id"), (F.col("rep_id") % 7).alias("label"))
    return prep.back_fill(p, labelled, "label")


@query(f"SELECT id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 8) AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) AS y FROM {CUST2D}")
def minmax_scale(spark, d):
    return prep.min_max(cust2d(spark, d), ["x", "y"]).select("id", F.round("x", 8).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT p_partkey, p_size FROM part")
def drop_constant_columns(spark, d):
    return prep.drop_constant(table(spark, d, "part").select("p_partkey", "p_size", F.lit(1).alias("same"), F.lit("a").alias("also")), ["p_size", "same", "also"])


@query(f"SELECT count(*) AS n, round(min(x), 6) AS xmin, round(max(x), 6) AS xmax, round(min(y), 3) AS ymin, round(max(y), 3) AS ymax FROM {CUST2D}")
def extent_stats(spark, d):
    e = prep.extent(cust2d(spark, d))
    return e.select("n", *[F.round(c, 6 if c[0] == "x" else 3).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT x, y FROM {PART2D})")
def distinct_points(spark, d):
    return prep.distinct_places(part2d(spark, d))


_USABLE = "(SELECT pt_id, lat, lon FROM hubei_points WHERE lat BETWEEN 15 AND 55 AND lon BETWEEN 70 AND 140)"


@query(f"SELECT pt_id, round(6378137.0 * radians(lon), 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y FROM {_USABLE}")
def web_mercator(spark, d):
    p = table(spark, d, "hubei_points").where(F.col("lat").between(15, 55) & F.col("lon").between(70, 140))
    x, y = geometry.to_mercator(F.col("lat"), F.col("lon"))
    return p.select("pt_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query(f"SELECT pt_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM {_USABLE}")
def web_mercator_inverse(spark, d):
    p = table(spark, d, "hubei_points").where(F.col("lat").between(15, 55) & F.col("lon").between(70, 140))
    x, y = geometry.to_mercator(F.col("lat"), F.col("lon"))
    lat, lon = geometry.from_mercator(x, y)
    return p.select("pt_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(f"SELECT id, y AS x, x AS y FROM {EMB2D}")
def swap_xy(spark, d):
    return emb2d(spark, d).select("id", F.col("y").alias("x"), F.col("x").alias("y"))


@query(f"SELECT id FROM {EMB2D} WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN 0 AND 0.2")
def envelope_filter(spark, d):
    box = [F.lit(v) for v in (-0.1, 0.0, 0.1, 0.2)]
    return emb2d(spark, d).where(geometry.in_envelope(F.col("x"), F.col("y"), *box)).select("id")


@query(f"SELECT id, CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy FROM {CUST2D}")
def half_open_cells(spark, d):
    return cust2d(spark, d).select("id", F.floor(F.col("x") / 5).alias("cx"), F.floor(F.col("y") / 5).alias("cy"))


# neighbours -----------------------------------------------------------------------------------------------------------


def _knn(points: str, k: int, name: str = "knn") -> str:
    return f"""{name}_p AS {points}, {name} AS (SELECT a.id, b.id AS nbr, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
      row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rank
      FROM {name}_p a JOIN {name}_p b ON a.id <> b.id QUALIFY rank <= {k})"""


@query(f"WITH {_knn(EMB2D, K)} SELECT id, CAST(rank AS INTEGER) AS rank, nbr, round(d2, 9) AS d2 FROM knn")
def knn_2d(spark, d):
    return neighbors.knn(emb2d(spark, d), K).withColumn("d2", F.round("d2", 9))


@query(f"WITH {_knn(PART2D, 5)} SELECT id, CAST(rank AS INTEGER) AS rank, nbr, d2 FROM knn")
def knn_ties(spark, d):
    return neighbors.knn(part2d(spark, d), 5)


@query(f"""WITH p AS {EMB64} SELECT a.id, CAST(row_number() OVER w AS INTEGER) AS rank, b.id AS nbr, round(list_distance(a.vec, b.vec) ** 2, 8) AS d2
  FROM p a JOIN p b ON a.id <> b.id WINDOW w AS (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) QUALIFY rank <= 10""")
def knn_64d(spark, d):
    return neighbors.knn(emb64(spark, d), 10, dims="vec").withColumn("d2", F.round("d2", 8))


@query(f"WITH {_knn(CUST2D, K)} SELECT id, CAST(rank AS INTEGER) AS rank, nbr, round(d2, 5) AS d2 FROM knn")
def knn_grid(spark, d):
    return neighbors.knn_grid(cust2d(spark, d), K).withColumn("d2", F.round("d2", 5))


_PAIR64 = f"WITH p AS {EMB64}, q AS (SELECT a.id, b.id AS nbr, {{}} AS dist FROM p a JOIN p b ON a.id <> b.id)"
_TOP = " SELECT id, CAST(row_number() OVER w AS INTEGER) AS rank, nbr, round(dist, 7) AS dist FROM q WINDOW w AS (PARTITION BY id ORDER BY dist, nbr) QUALIFY rank <= 5"
_ZIP = "list_zip(a.vec, b.vec)"


def _metric(name: str, metric: str, sql: str, **options) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return neighbors.knn_metric(emb64(spark, d), 5, metric, dims="vec", **options).withColumn("dist", F.round("dist", 7))

    QUERIES[name] = run
    ORACLE[name] = _PAIR64.format(sql) + _TOP


_metric("knn_metric_cityblock", "cityblock", f"list_sum(list_transform({_ZIP}, lambda z: abs(z[1] - z[2])))")
_metric("knn_metric_chebychev", "chebychev", f"list_max(list_transform({_ZIP}, lambda z: abs(z[1] - z[2])))")
_metric("knn_metric_minkowski3", "minkowski", f"pow(list_sum(list_transform({_ZIP}, lambda z: pow(abs(z[1] - z[2]), 3))), 1.0 / 3)", p=3.0)
_VARS = [0.5 + i / 64 for i in range(64)]
_metric("knn_metric_seuclidean", "seuclidean", f"sqrt(list_sum(list_transform(list_zip(a.vec, b.vec, {_VARS}), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / z[3])))", variances=_VARS)
_metric("knn_metric_cosine", "cosine", "1 - list_cosine_similarity(a.vec, b.vec)")
_metric("knn_metric_correlation", "correlation", "1 - list_cosine_similarity(list_transform(a.vec, lambda v: v - list_avg(a.vec)), list_transform(b.vec, lambda v: v - list_avg(b.vec)))")


_BITDIST = "bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1))"


@query(f"""WITH p AS {BITS64} SELECT a.id, CAST(row_number() OVER w AS INTEGER) AS rank, b.id AS nbr, CAST({_BITDIST} AS INTEGER) AS dist FROM p a JOIN p b ON a.id <> b.id
  WINDOW w AS (PARTITION BY a.id ORDER BY {_BITDIST}, b.id) QUALIFY rank <= 5""")
def hamming_knn(spark, d):
    return neighbors.hamming_knn(bits64(spark, d), 5).select("id", "rank", "nbr", F.col("dist").cast("int").alias("dist"))


_MASKS = [[0x00FF00F0, 0x0000F00F], [0x0F0F0000, 0x0F000F00], [0x0000FF0F, 0x00F000F0]]


@query(f"WITH p AS {BITS64} SELECT DISTINCT a.id, b.id AS nbr FROM p a JOIN p b ON a.id <> b.id AND (" + " OR ".join(f"bit_count(xor(a.w0, b.w0) & {m[0]}) + bit_count(xor(a.w1, b.w1) & {m[1]}) <= 1" for m in _MASKS) + ")")
def lsh_candidates(spark, d):
    return neighbors.lsh_candidates(bits64(spark, d), _MASKS, 1)


@query()
def knn_approximate_recall(spark, d):
    """Share of the true neighbours that leaves of about 200 points find by themselves."""
    p = cust2d(spark, d)
    return neighbors.recall(neighbors.knn(p, K, leaf_rows=200, approximate=True), neighbors.knn(p, K))


@query()
def knn_tuned_leaf(spark, d):
    rows = neighbors.tuned_leaf_rows(cust2d(spark, d), K, 0.9, share=0.1)
    return spark.range(1).select(F.lit(rows).alias("leaf_rows"))


_R = 0.05
_RADIUS = f"WITH p AS {EMB2D}, r AS (SELECT a.id, b.id AS nbr, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.id <> b.id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0025)"


@query(f"{_RADIUS} SELECT id, nbr, round(d2, 9) AS d2 FROM r")
def radius_join(spark, d):
    p = emb2d(spark, d)
    return neighbors.radius_pairs(p, p, _R).withColumn("d2", F.round("d2", 9))


@query(f"WITH p AS {PART2D} SELECT a.id, b.id AS nbr FROM p a JOIN p b ON a.id <> b.id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 1")
def radius_strict(spark, d):
    """Nearer than 1: with whole coordinates, the same place."""
    p = part2d(spark, d)
    return neighbors.radius_pairs(p, p, 1.0, strict=True).select("id", "nbr")


@query(f"{_RADIUS} SELECT id, count(nbr) AS n FROM p LEFT JOIN r USING (id) GROUP BY id")
def radius_count(spark, d):
    return neighbors.radius_count(emb2d(spark, d), _R)


@query(f"{_RADIUS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY d2, nbr) AS INTEGER) AS rank, nbr, round(d2, 9) AS d2 FROM r QUALIFY rank <= 3")
def radius_capped(spark, d):
    return neighbors.radius_capped(emb2d(spark, d), _R, 3).withColumn("d2", F.round("d2", 9))


@query(f"""WITH p AS {EMB2D} SELECT a.id, CAST(1 AS INTEGER) AS rank, b.id AS nbr, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9) AS d2 FROM p a JOIN p b ON a.label <> 3 AND b.label = 3
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) = 1""")
def nearest_in_subset(spark, d):
    p = emb2d(spark, d)
    return neighbors.nearest_in(p.where("label <> 3"), p.where("label = 3"), 1).withColumn("d2", F.round("d2", 9))


@query(f"WITH {_knn(EMB2D, K)} SELECT p.id, count(k.nbr) AS n FROM knn_p p LEFT JOIN knn k ON k.nbr = p.id GROUP BY p.id")
def reverse_knn_count(spark, d):
    p = emb2d(spark, d)
    return neighbors.reverse_count(neighbors.knn(p, K), p)


@query(f"WITH {_knn(EMB2D, K)} SELECT id, nbr FROM knn UNION SELECT nbr, id FROM knn")
def natural_influence_space(spark, d):
    return neighbors.influence_space(neighbors.knn(emb2d(spark, d), K))


@query(f"""WITH {_knn(EMB2D, K)}, o AS (SELECT id, nbr FROM knn UNION ALL SELECT id, id FROM knn_p)
  SELECT a.id AS src, b.id AS dst, count(*) AS shared, count(*) / (22.0 - count(*)) AS weight FROM o a JOIN o b ON a.nbr = b.nbr AND a.id < b.id GROUP BY 1, 2""")
def snn_edges(spark, d):
    return neighbors.shared_neighbours(neighbors.knn(emb2d(spark, d), K), K)


# boundaries and clusters ----------------------------------------------------------------------------------------------

_ANGLES = """ang AS (SELECT k.id, k.nbr, CASE WHEN atan2(b.y - a.y, b.x - a.x) < 0 THEN atan2(b.y - a.y, b.x - a.x) + 2 * pi() ELSE atan2(b.y - a.y, b.x - a.x) END AS angle
  FROM knn k JOIN knn_p a ON a.id = k.id JOIN knn_p b ON b.id = k.nbr)"""


def _dcm(ddof: int = 0) -> str:
    return f"""dcm AS (SELECT id, sum(pow(gap - 2 * pi() / n, 2)) / (max(n) - {ddof}) / ((max(n) - 1) * 4 * pi() * pi() / (max(n) * max(n))) AS dcm FROM (
      SELECT id, count(*) OVER (PARTITION BY id) AS n, coalesce(lead(angle) OVER (PARTITION BY id ORDER BY angle), min(angle) OVER (PARTITION BY id) + 2 * pi()) - angle AS gap FROM ang) GROUP BY id)"""


def _flags(points: str = EMB2D, k: int = K, at: str = "CAST(ceil(n * CAST(0.7 AS DOUBLE)) AS BIGINT)") -> str:
    return f"""{_knn(points, k)}, {_ANGLES}, {_dcm()}, t AS (SELECT max(dcm) AS t FROM (SELECT dcm, row_number() OVER (ORDER BY dcm) AS r, count(*) OVER () AS n FROM dcm) WHERE r <= {at}),
      flg AS (SELECT id, dcm, dcm < t AS is_internal FROM dcm, t)"""


_NEAR = """opp AS (SELECT a.id, fa.is_internal, b.id AS nbr, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM knn_p a JOIN flg fa ON fa.id = a.id JOIN flg fb ON fb.is_internal <> fa.is_internal JOIN knn_p b ON b.id = fb.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) = 1),
  balls AS (SELECT p.id, p.x, p.y, sqrt(o.d2) AS reach FROM knn_p p JOIN opp o ON o.id = p.id WHERE o.is_internal)"""
_OVERLAPS = "ovl AS (SELECT a.id AS src, b.id AS dst FROM balls a JOIN balls b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= a.reach + b.reach)"
_COMP = """sym AS (SELECT src, dst FROM ovl UNION ALL SELECT dst, src FROM ovl), walk AS (SELECT id, id AS r FROM balls UNION SELECT s.dst, w.r FROM walk w JOIN sym s ON s.src = w.id WHERE w.r < s.dst),
  comp AS (SELECT id, min(r) AS component FROM walk GROUP BY id)"""
_LABELS = """lab AS (SELECT id, component FROM comp UNION ALL SELECT o.id, c.component FROM opp o JOIN comp c ON c.id = o.nbr WHERE NOT o.is_internal),
  clu AS (SELECT id, CAST(dense_rank() OVER (ORDER BY f) AS INTEGER) AS cluster FROM (SELECT id, min(id) OVER (PARTITION BY component) AS f FROM lab))"""


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = emb2d(spark, d)
    return p, neighbors.knn(p, K)


@query(f"WITH {_knn(EMB2D, K)}, {_ANGLES} SELECT id, nbr, round(angle, 8) AS angle FROM ang")
def neighbor_angles(spark, d):
    p, e = _scored(spark, d)
    return centrality.neighbour_angles(e, p).withColumn("angle", F.round("angle", 8))


@query(f"WITH {_knn(EMB2D, K)}, {_ANGLES}, {_dcm()} SELECT id, round(dcm, 8) AS dcm FROM dcm")
def dcm_2d(spark, d):
    p, e = _scored(spark, d)
    return cluster.scores(e, p, ["x", "y"]).withColumn("dcm", F.round("dcm", 8))


@query(f"WITH {_knn(EMB2D, K)}, {_ANGLES}, {_dcm(1)} SELECT id, round(dcm, 8) AS dcm FROM dcm")
def dcm_2d_sample_var(spark, d):
    p, e = _scored(spark, d)
    return cluster.scores(e, p, ["x", "y"], ddof=1).withColumn("dcm", F.round("dcm", 8))


@query(f"WITH {_knn(EMB2D, K - 1)}, {_ANGLES}, {_dcm()} SELECT id, round(dcm, 8) AS dcm FROM dcm")
def dcm_2d_self_included(spark, d):
    """A k that counts the point itself means k - 1 neighbours."""
    p, e = _scored(spark, d)
    return cluster.scores(e.where(F.col("rank") <= K - 1), p, ["x", "y"]).withColumn("dcm", F.round("dcm", 8))


@query(f"WITH {_flags()} SELECT id, round(dcm, 8) AS dcm, is_internal FROM flg")
def dcm_flags(spark, d):
    p, e = _scored(spark, d)
    return centrality.flags(cluster.scores(e, p, ["x", "y"]), RATIO).withColumn("dcm", F.round("dcm", 8))


@query(f"WITH {_flags(at='CAST(ceil(n * CAST(0.7 AS DOUBLE)) AS BIGINT) + 1')} SELECT id, is_internal FROM flg")
def dcm_flags_next_rule(spark, d):
    p, e = _scored(spark, d)
    return centrality.flags(cluster.scores(e, p, ["x", "y"]), RATIO, "next").select("id", "is_internal")


@query(f"WITH {_flags(at='n - CAST(floor(n * CAST(0.25 AS DOUBLE)) AS BIGINT) + 1')} SELECT id, is_internal FROM flg")
def dcm_flags_boundary_ratio(spark, d):
    p, e = _scored(spark, d)
    return centrality.flags(cluster.scores(e, p, ["x", "y"]), 0.75, "boundary").select("id", "is_internal")


@query(f"WITH {_flags()}, {_NEAR} SELECT id, round(reach, 8) AS reach FROM balls")
def reach_distance(spark, d):
    return connect.reach(cluster.run(emb2d(spark, d), K, RATIO).near).withColumn("reach", F.round("reach", 8))


@query(f"WITH {_flags()}, {_NEAR} SELECT id, nbr AS anchor_id FROM opp WHERE NOT is_internal")
def anchor_point(spark, d):
    return connect.anchors(cluster.run(emb2d(spark, d), K, RATIO).near)


@query(f"WITH {_flags()}, {_NEAR}, {_OVERLAPS} SELECT src, dst FROM ovl")
def overlap_edges(spark, d):
    return cluster.run(emb2d(spark, d), K, RATIO).overlaps


@query(f"WITH RECURSIVE {_flags()}, {_NEAR}, {_OVERLAPS}, {_COMP} SELECT id, component FROM comp")
def internal_components(spark, d):
    return cluster.run(emb2d(spark, d), K, RATIO).components


@query(f"WITH RECURSIVE {_flags()}, {_NEAR}, {_OVERLAPS}, {_COMP}, {_LABELS} SELECT id, cluster FROM clu")
def cluster_labels(spark, d):
    return cluster.cluster(emb2d(spark, d), K, RATIO)


@query(f"WITH RECURSIVE {_flags()}, {_NEAR}, {_OVERLAPS}, {_COMP}, {_LABELS} SELECT cluster, count(*) AS n FROM clu GROUP BY cluster")
def cluster_sizes(spark, d):
    return cluster.cluster(emb2d(spark, d), K, RATIO).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_PLACES = f"(SELECT min(id) AS id, x, y FROM {PART2D} GROUP BY x, y)"


@query(f"""WITH RECURSIVE {_flags(_PLACES)}, {_NEAR}, {_OVERLAPS}, {_COMP}, {_LABELS}
  SELECT q.id, c.cluster FROM {PART2D} q JOIN knn_p p ON p.x = q.x AND p.y = q.y JOIN clu c ON c.id = p.id""")
def cluster_with_duplicates(spark, d):
    return cluster.cluster(part2d(spark, d), K, RATIO)


@query()
def cluster_single_pass(spark, d):
    return cluster.cluster(emb2d(spark, d), K, RATIO, merge="single_pass")


@query()
def dcm_hull_3d(spark, d):
    p = emb3d(spark, d)
    return centrality.dcm_hull(neighbors.knn(p, K, dims=["x", "y", "z"]), p, ["x", "y", "z"])


@query()
def dcm_local_pca(spark, d):
    p = emb64(spark, d)
    return centrality.dcm_local(neighbors.knn(p, K, dims="vec"), p, "vec", centrality.local_dimensions(64, K))


@query()
def cluster_3d(spark, d):
    return cluster.cluster(emb3d(spark, d), K, RATIO, dims=("x", "y", "z"))


# noise ----------------------------------------------------------------------------------------------------------------

_LOF = f"""{_knn(EMB2D, K)}, kd AS (SELECT id, max(sqrt(d2)) AS kd FROM knn GROUP BY id), lrd AS (SELECT k.id, count(*) / sum(greatest(kd.kd, sqrt(k.d2))) AS lrd FROM knn k JOIN kd ON kd.id = k.nbr GROUP BY k.id),
  lf AS (SELECT k.id, avg(n.lrd) / any_value(o.lrd) AS lof FROM knn k JOIN lrd n ON n.id = k.nbr JOIN lrd o ON o.id = k.id GROUP BY k.id)"""


@query(f"WITH {_LOF} SELECT id, round(lof, 7) AS lof, (lof - min(lof) OVER ()) / (max(lof) OVER () - min(lof) OVER ()) > 0.1 AS is_noise FROM lf")
def noise_lof(spark, d):
    return noise.lof(neighbors.knn(emb2d(spark, d), K), 0.1).select("id", F.round("lof", 7).alias("lof"), "is_noise")


@query(f"WITH {_knn(EMB2D, K)}, c AS (SELECT p.id, count(k.nbr) AS n FROM knn_p p LEFT JOIN knn k ON k.nbr = p.id GROUP BY p.id) SELECT id, n, (n - min(n) OVER ()) / CAST(max(n) OVER () - min(n) OVER () AS DOUBLE) < 0.2 AS is_noise FROM c")
def noise_rknn(spark, d):
    p = emb2d(spark, d)
    return noise.rknn(neighbors.knn(p, K), p, 0.2).select("id", "n", "is_noise")


@query(f"WITH {_knn(EMB2D, K)} SELECT id, round(1 / sum(sqrt(d2)), 7) AS idm, 1 / sum(sqrt(d2)) < 2 AS is_noise FROM knn GROUP BY id")
def noise_idm(spark, d):
    return noise.idm(neighbors.knn(emb2d(spark, d), K), 2.0).select("id", F.round("idm", 7).alias("idm"), "is_noise")


_QUIET = f"(WITH {_knn(EMB2D, K, 'nz')} SELECT id, x, y FROM nz_p WHERE id NOT IN (SELECT id FROM nz GROUP BY id HAVING 1 / sum(sqrt(d2)) < 2))"


@query(f"WITH RECURSIVE {_flags(_QUIET)}, {_NEAR}, {_OVERLAPS}, {_COMP}, {_LABELS} SELECT p.id, coalesce(c.cluster, 0) AS cluster FROM {EMB2D} p LEFT JOIN clu c ON c.id = p.id")
def cluster_without_noise(spark, d):
    p = emb2d(spark, d)
    return cluster.cluster_without_noise(p, noise.idm(neighbors.knn(p, K), 2.0).where("is_noise"), K, RATIO)


# evaluation -----------------------------------------------------------------------------------------------------------

_PAIRED = "(SELECT n_nationkey % 5 AS t, c_custkey % 4 AS p FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return evaluate.contingency(both.select((F.col("n_nationkey") % 5).alias("t"), (F.col("c_custkey") % 4).alias("p")), "t", "p")


_CONT = f"c AS (SELECT t, p, count(*) AS n FROM {_PAIRED} GROUP BY t, p), a AS (SELECT t, sum(n) AS a FROM c GROUP BY t), b AS (SELECT p, sum(n) AS b FROM c GROUP BY p)"
_PC = f"""{_CONT}, pc AS (SELECT ss, st - ss AS sd, sp - ss AS ds, n * (n - 1) / 2.0 - st - sp + ss AS dd FROM (SELECT
  (SELECT sum(CAST(n AS DOUBLE) * (n - 1) / 2) FROM c) AS ss, (SELECT sum(CAST(a AS DOUBLE) * (a - 1) / 2) FROM a) AS st, (SELECT sum(CAST(b AS DOUBLE) * (b - 1) / 2) FROM b) AS sp, (SELECT CAST(sum(n) AS DOUBLE) FROM c) AS n))"""


@query(f"WITH {_CONT} SELECT t AS true_label, p AS pred_label, n FROM c")
def contingency(spark, d):
    return _labels(spark, d)


@query(f"WITH {_PC} SELECT ss, sd, ds, CAST(dd AS DOUBLE) AS dd FROM pc")
def pair_counts(spark, d):
    return evaluate.pair_counts(_labels(spark, d))


def _pair_metric(name: str, col: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return evaluate.pair_metrics(_labels(spark, d)).select(F.round(col, 8).alias(name))

    QUERIES[name] = run
    ORACLE[name] = f"WITH {_PC} SELECT round({sql}, 8) AS {name} FROM pc"


_pair_metric("ari", "ari", "2 * (ss * dd - ds * sd) / ((ss + sd) * (sd + dd) + (ss + ds) * (ds + dd))")
_pair_metric("rand_index", "rand", "(ss + dd) / (ss + sd + ds + dd)")
_pair_metric("jaccard_index", "jaccard", "ss / (ss + sd + ds)")
_pair_metric("f_measure", "f_measure", "2 * (ss / (ss + ds)) * (ss / (ss + sd)) / (ss / (ss + ds) + ss / (ss + sd))")
_pair_metric("pair_precision", "precision", "ss / (ss + ds)")
_pair_metric("pair_recall", "recall", "ss / (ss + sd)")


@query(f"""WITH {_CONT}, s AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM c) SELECT round(2 * (SELECT sum(c.n / s.n * ln(c.n * s.n / (a.a * b.b))) FROM c JOIN a USING (t) JOIN b USING (p), s)
  / ((SELECT sum(-a / s.n * ln(a / s.n)) FROM a, s) + (SELECT sum(-b / s.n * ln(b / s.n)) FROM b, s)), 8) AS nmi""")
def nmi(spark, d):
    return evaluate.nmi(_labels(spark, d)).select(F.round("nmi", 8).alias("nmi"))


@query(f"WITH {_CONT} SELECT round(sum(m) / CAST(sum(s) AS DOUBLE), 8) AS purity FROM (SELECT max(n) AS m, sum(n) AS s FROM c GROUP BY p)")
def purity(spark, d):
    return evaluate.purity(_labels(spark, d)).select(F.round("purity", 8).alias("purity"))


@query(f"WITH {_CONT} SELECT round(sum(m) / CAST(sum(s) AS DOUBLE), 8) AS inverse_purity FROM (SELECT max(n) AS m, sum(n) AS s FROM c GROUP BY t)")
def inverse_purity(spark, d):
    return evaluate.purity(_labels(spark, d)).select(F.round("inverse_purity", 8).alias("inverse_purity"))


@query()
def matched_accuracy(spark, d):
    return evaluate.matched_accuracy(_labels(spark, d))


@query(f"""WITH {_CONT} SELECT coalesce(a.t, b.p) AS label, CAST(coalesce(c.n, 0) AS BIGINT) AS tp, CAST(coalesce(b.b, 0) - coalesce(c.n, 0) AS BIGINT) AS fp, CAST(coalesce(a.a, 0) - coalesce(c.n, 0) AS BIGINT) AS fn
  FROM a FULL JOIN b ON a.t = b.p LEFT JOIN c ON c.t = a.t AND c.p = a.t""")
def class_confusion(spark, d):
    return evaluate.class_scores(_labels(spark, d)).select("label", "tp", "fp", "fn")


# sweeps and baselines -------------------------------------------------------------------------------------------------


def _sweep_one(k: int, ratio: float) -> str:
    """One setting: clusters of all points against the labels, and the adjusted Rand index of the two."""
    clusters = f"WITH RECURSIVE {_flags(k=k, at=f'CAST(ceil(n * CAST({ratio} AS DOUBLE)) AS BIGINT)')}, {_NEAR}, {_OVERLAPS}, {_COMP}, {_LABELS} SELECT id, cluster FROM clu"
    return f"""(WITH lc AS ({clusters}), c AS (SELECT label AS t, cluster AS p, count(*) AS n FROM lc JOIN {EMB2D} USING (id) GROUP BY ALL),
      s AS (SELECT sum(CAST(n AS DOUBLE) * (n - 1) / 2) AS ss, (SELECT sum(CAST(a AS DOUBLE) * (a - 1) / 2) FROM (SELECT sum(n) AS a FROM c GROUP BY t)) AS st, (SELECT sum(CAST(b AS DOUBLE) * (b - 1) / 2) FROM (SELECT sum(n) AS b FROM c GROUP BY p)) AS sp, sum(n) AS n FROM c),
      q AS (SELECT ss, st - ss AS sd, sp - ss AS ds, CAST(n AS DOUBLE) * (n - 1) / 2 - st - sp + ss AS dd FROM s)
      SELECT CAST({k} AS INTEGER) AS k, CAST({ratio} AS DOUBLE) AS ratio, (SELECT max(cluster) FROM lc) AS clusters, round(2 * (ss * dd - ds * sd) / ((ss + sd) * (sd + dd) + (ss + ds) * (ds + dd)), 8) AS ari FROM q)"""


_SWEEP = " UNION ALL ".join(f"SELECT * FROM {_sweep_one(k, r)}" for k in (8, 10) for r in (0.6, 0.7))


@query(_SWEEP)
def sweep_k_ratio(spark, d):
    return sweep.sweep(emb2d(spark, d), [8, 10], [0.6, 0.7], "label").withColumn("ari", F.round("ari", 8))


@query(f"""WITH w AS ({_SWEEP}) SELECT round(avg(ari), 6) AS mean_ari, round(max(ari), 6) AS max_ari, arg_max(clusters, ari) AS clusters FROM w""")
def sweep_scores(spark, d):
    """The mean and greatest index, and the clusters of the setting that reaches it."""
    b = sweep.best(sweep.sweep(emb2d(spark, d), [8, 10], [0.6, 0.7], "label"))
    return b.select(F.round("mean_ari", 6).alias("mean_ari"), F.round("max_ari", 6).alias("max_ari"), "clusters")


@query()
def sweep_best(spark, d):
    return sweep.best(sweep.sweep(emb2d(spark, d), [8, 10], [0.6, 0.7], "label"))


@query()
def kmeans_baseline(spark, d):
    return baselines.k_means(emb64(spark, d), 10, "vec")


_DB = f"""WITH RECURSIVE p AS {EMB2D}, r AS (SELECT a.id, b.id AS nbr, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0004),
  core AS (SELECT id FROM r GROUP BY id HAVING count(*) + 1 >= 5), l AS (SELECT id, nbr FROM r WHERE id IN (FROM core) AND nbr IN (FROM core)),
  walk AS (SELECT id, id AS c FROM core UNION SELECT l.nbr, w.c FROM walk w JOIN l ON l.id = w.id WHERE w.c < l.nbr), comp AS (SELECT id, min(c) AS c FROM walk GROUP BY id),
  num AS (SELECT id, CAST(dense_rank() OVER (ORDER BY c) AS INTEGER) AS cluster FROM comp),
  bor AS (SELECT r.id, n.cluster FROM r JOIN num n ON n.id = r.nbr WHERE r.id NOT IN (FROM core) QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY d2, nbr) = 1)
  SELECT p.id, coalesce(num.cluster, bor.cluster, 0) AS cluster, num.id IS NOT NULL AS is_core FROM p LEFT JOIN num ON num.id = p.id LEFT JOIN bor ON bor.id = p.id"""


@query(_DB)
def dbscan(spark, d):
    return baselines.dbscan(emb2d(spark, d), 0.02, 5)


@query(f"""WITH p AS {EMB2D}, n AS (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rk FROM p a JOIN p b ON a.id % 10 = 0 AND b.id % 10 <> 0 QUALIFY rk <= 5)
  SELECT id, label FROM (SELECT id, label, count(*) AS c, min(rk) AS f FROM n GROUP BY id, label) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, f) = 1""")
def assign_new_points(spark, d):
    """New points are those with an id divisible by 10; the others are labelled."""
    p = emb2d(spark, d)
    return baselines.assign_by_vote(p.where("id % 10 = 0"), p.where("id % 10 <> 0"), "label", 5)


@query()
def mlp_predict(spark, d):
    p = emb64(spark, d)
    return baselines.perceptron(p, p, "label", "vec")


@query()
def pca_2d(spark, d):
    return prep.principal_components(emb64(spark, d), "vec", 2)[0]


# geometry -------------------------------------------------------------------------------------------------------------

_RINGS = "(SELECT objectid, coordinates[1] AS r FROM hubei_463 WHERE coordinates IS NOT NULL QUALIFY row_number() OVER (PARTITION BY objectid) = 1)"


def _rings(spark: SparkSession, d: str) -> DataFrame:
    ring = F.transform(F.element_at("coordinates", 1), lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))
    return table(spark, d, "hubei_463").where("coordinates is not null").dropDuplicates(["objectid"]).select("objectid", ring.alias("ring"))


@query(f"SELECT objectid, list_min(list_transform(r, lambda p: p[1])) AS xmin, list_min(list_transform(r, lambda p: p[2])) AS ymin, list_max(list_transform(r, lambda p: p[1])) AS xmax, list_max(list_transform(r, lambda p: p[2])) AS ymax FROM {_RINGS}")
def region_envelopes(spark, d):
    return _rings(spark, d).select("objectid", geometry.envelope(F.col("ring")).alias("e")).select("objectid", "e.*")


@query(f"SELECT id FROM {CUST2D} WHERE (x - 40) * (x - 40) + (y - 100) * (y - 100) <= 900")
def circle_covers(spark, d):
    return cust2d(spark, d).where(geometry.circle_covers(F.lit(40.0), F.lit(100.0), F.lit(30.0), F.col("x"), F.col("y"))).select("id")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    p = cust2d(spark, d)
    return p.alias("a").join(p.alias("b"), F.col("b.id") == F.col("a.id") + 1).select(F.col("a.id").alias("id"), F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


@query(f"""WITH p AS {CUST2D}, s AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x - a.x AS dx, b.y - a.y AS dy FROM p a JOIN p b ON b.id = a.id + 1),
  t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((40 - x1) * dx + (100 - y1) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM s)
  SELECT id FROM t WHERE pow(x1 + t * dx - 40, 2) + pow(y1 + t * dy - 100, 2) <= 900""")
def segment_circle(spark, d):
    s = _segments(spark, d)
    return s.where(geometry.circle_meets_segment(F.lit(40.0), F.lit(100.0), F.lit(30.0), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])).select("id")


@query(f"""WITH e AS (SELECT objectid, r[i][1] AS x1, r[i][2] AS y1, r[i % len(r) + 1][1] AS x2, r[i % len(r) + 1][2] AS y2 FROM {_RINGS}, range(1, 5000) t(i) WHERE i <= len(r)),
  s AS (SELECT s_suppkey AS id, 90 + s_suppkey % 30 AS x, 22 + s_suppkey % 20 AS y FROM supplier)
  SELECT id, objectid FROM s JOIN e ON (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY id, objectid HAVING count(*) % 2 = 1""")
def point_in_polygon(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (90 + F.col("s_suppkey") % 30).cast("double").alias("x"), (22 + F.col("s_suppkey") % 20).cast("double").alias("y"))
    # regions lie in all whole-degree cells of their envelope, a point in one
    e = geometry.envelope(F.col("ring"))
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(lo), F.floor(hi)))
    rings = _rings(spark, d).withColumn("e", e).withColumn("cx", spread(F.col("e.xmin"), F.col("e.xmax"))).withColumn("cy", spread(F.col("e.ymin"), F.col("e.ymax")))
    near = p.withColumns({"cx": F.floor("x"), "cy": F.floor("y")}).join(rings, ["cx", "cy"])
    return near.where(geometry.in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("id", "objectid")


_EDGES = f"(SELECT objectid, r[i][1] AS x1, r[i][2] AS y1, r[i % len(r) + 1][1] AS x2, r[i % len(r) + 1][2] AS y2 FROM {_RINGS}, range(1, 5000) t(i) WHERE i <= len(r))"


@query(f"""WITH e AS {_EDGES}, t AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM e), s AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, ((105 - x1) * dx + (32 - y1) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM t)
  SELECT objectid FROM s GROUP BY objectid HAVING min(pow(x1 + t * dx - 105, 2) + pow(y1 + t * dy - 32, 2)) <= 4
  OR count(*) FILTER (WHERE (y1 > 32) <> (y2 > 32) AND 105 < x1 + (32 - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1""")
def circle_polygon(spark, d):
    """Regions that a circle of 2 degrees around (105, 32) touches."""
    circle = [F.lit(v) for v in (105.0, 32.0, 2.0)]
    return _rings(spark, d).where(geometry.circle_meets_ring(*circle, F.col("ring"))).select("objectid")


@query(f"SELECT id, x, y FROM {EMB2D}")
def wkt_roundtrip(spark, d):
    text = emb2d(spark, d).select("id", geometry.wkt_point(F.col("x"), F.col("y")).alias("wkt"))
    return text.select("id", geometry.read_wkt_point(F.col("wkt")).alias("p")).select("id", "p.x", "p.y")


@query(f"SELECT objectid, len(r) AS n, list_sum(list_transform(r, lambda p: round(p[1], 6))) AS sx FROM {_RINGS}".replace("list_sum", "round(list_sum").replace(") AS sx", "), 4) AS sx"))
def wkt_polygon_roundtrip(spark, d):
    text = _rings(spark, d).select("objectid", geometry.wkt_polygon(F.col("ring")).alias("wkt"))
    ring = F.element_at(geometry.read_wkt_rings(F.col("wkt")), 1)
    total = F.aggregate(ring, F.lit(0.0), lambda s, p: s + F.round(p["x"], 6))
    return text.select("objectid", F.size(ring).cast("long").alias("n"), F.round(total, 4).alias("sx"))


@query(f"SELECT id, x, y, label FROM {EMB2D}")
def geojson_roundtrip(spark, d):
    text = emb2d(spark, d).select("id", geometry.geojson_point(F.col("x"), F.col("y"), label=F.col("label")).alias("j"))
    return text.select("id", geometry.read_geojson_point(F.col("j"), "label: int").alias("p")).select("id", "p.x", "p.y", F.col("p.properties.label").alias("label"))
