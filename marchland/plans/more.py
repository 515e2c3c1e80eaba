"""Queries of samples, ranges, geometry texts and predicates, graphs, bins, approximate searches, and invariants of results that SQL
can't compute."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from marchland.functions import geometry
from marchland.operators import centrality, cluster, communities, evaluate, graph, neighbors, partitioning, prep
from marchland.plans.load import table
from marchland.plans.points import CUST2D, EMB2D, PART2D, cust2d, emb2d, emb3d, emb64, part2d
from marchland.plans.reference import _CONT, _RINGS, _labels, _rings
from marchland.session import new_path
from marchland.sources import points as files

K = 10
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY x, y, id) AS INTEGER) AS place FROM {PART2D}")
def ordered_by_place(spark, d):
    return prep.dense_numbers(part2d(spark, d), ["x", "y", "id"], "place").select("id", "place")


@query(f"SELECT id, x, y FROM {PART2D} QUALIFY row_number() OVER (ORDER BY id) BETWEEN 11 AND 60")
def row_range(spark, d):
    return prep.row_range(part2d(spark, d), "id", 11, 50)


@query(f"SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS ids, CAST(100 AS BIGINT) AS known FROM {CUST2D} LIMIT 1")
def sample_of_rows(spark, d):
    """Counts of a sample of 100: rows, different ids, ids of the table."""
    p = cust2d(spark, d)
    s = prep.sample_rows(p, 100)
    known = s.join(p.select("id", F.lit(1).alias("there")), "id", "left")
    return known.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count("there").alias("known"))


_LONG = "(SELECT i - 1 AS gene, abs(CAST(embedding[i] AS DOUBLE)) AS value FROM embeddings, range(1, 65) t(i))"


@query(f"""WITH g AS (SELECT gene, avg(value) AS mean, var_samp(value) / avg(value) AS dispersion FROM {_LONG} GROUP BY gene)
  SELECT gene, round(dispersion, 9) AS dispersion, CAST(row_number() OVER (ORDER BY dispersion DESC, gene) AS INTEGER) AS rank FROM g QUALIFY rank <= 20""")
def variable_genes(spark, d):
    long = emb64(spark, d).select(F.posexplode("vec").alias("gene", "value")).withColumns({"gene": F.col("gene").cast("long"), "value": F.abs("value")})
    return prep.variable_genes(long, 20).select("gene", F.round("dispersion", 9).alias("dispersion"), "rank")


@query("""WITH v AS (SELECT vec_id AS id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i))
  SELECT id, round(sum((v - lo) / (hi - lo)), 7) AS total FROM v JOIN (SELECT i, min(v) AS lo, max(v) AS hi FROM v GROUP BY i) USING (i) GROUP BY id""")
def minmax_vectors(spark, d):
    """The sum of each vector's components, every component scaled to 0 .. 1."""
    v = prep.min_max_array(emb64(spark, d), "vec")
    return v.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, e: s + e), 7).alias("total"))


@query(f"SELECT id, CAST(2 AS INTEGER) AS kept, x, y FROM {EMB2D}")
def drop_constant_components(spark, d):
    v = emb2d(spark, d).select("id", F.array(F.lit(1.0), "x", F.lit(0.0), "y").alias("vec"))
    return prep.drop_constant_components(v, "vec").select("id", F.size("vec").alias("kept"), F.get("vec", 0).alias("x"), F.get("vec", 1).alias("y"))


@query("""WITH v AS (SELECT vec_id AS id, i - 1 AS gene, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i))
  SELECT id, gene, round(least(2.5, (v - avg(v) OVER (PARTITION BY gene)) / stddev_samp(v) OVER (PARTITION BY gene)), 7) AS value FROM v""")
def standardised(spark, d):
    long = emb64(spark, d).select("id", F.posexplode("vec").alias("gene", "value")).withColumn("gene", F.col("gene").cast("long"))
    return prep.standardise(long, most=2.5).select("id", "gene", F.round("value", 7).alias("value"))


# geometry -------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, y AS x, x AS y FROM {EMB2D}")
def swapped_points(spark, d):
    ring = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")))
    return emb2d(spark, d).select("id", F.element_at(geometry.swapped(ring), 1).alias("p")).select("id", "p.x", "p.y")


_ENV = f"(SELECT objectid, list_min(list_transform(r, lambda p: p[1])) AS xmin, list_min(list_transform(r, lambda p: p[2])) AS ymin, list_max(list_transform(r, lambda p: p[1])) AS xmax, list_max(list_transform(r, lambda p: p[2])) AS ymax FROM {_RINGS})"


def _envelopes(spark, d):
    return _rings(spark, d).select("objectid", geometry.envelope(F.col("ring")).alias("e"))


@query(f"""WITH e AS {_ENV} SELECT a.objectid AS a, b.objectid AS b, a.xmin <= b.xmin AND a.ymin <= b.ymin AND a.xmax >= b.xmax AND a.ymax >= b.ymax AS covers
  FROM e a JOIN e b ON a.objectid <> b.objectid AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax""")
def region_pairs(spark, d):
    """Regions whose envelopes meet, found over whole-degree cells; the cell of the pair's reference point reports it once."""
    e = _envelopes(spark, d)
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo), F.floor(hi)))
    placed = e.withColumn("cx", cells(F.col("e.xmin"), F.col("e.xmax"))).withColumn("cy", cells(F.col("e.ymin"), F.col("e.ymax")))
    a, b = placed.select(F.col("objectid").alias("a"), F.col("e").alias("ea"), "cx", "cy"), placed.select(F.col("objectid").alias("b"), F.col("e").alias("eb"), "cx", "cy")
    ref = geometry.reference_point(F.col("ea"), F.col("eb"))
    met = a.join(b, ["cx", "cy"]).where((F.col("a") != F.col("b")) & geometry.envelopes_meet(F.col("ea"), F.col("eb")))
    once = met.where((F.floor(ref["x"]) == F.col("cx")) & (F.floor(ref["y"]) == F.col("cy")))
    return once.select("a", "b", geometry.envelope_covers(F.col("ea"), F.col("eb")).alias("covers"))


@query(f"""SELECT id, kind, n, round(sx, 4) AS sx FROM (
  SELECT id, 'POINT' AS kind, 1 AS n, x AS sx FROM {EMB2D} UNION ALL SELECT id, 'LINESTRING', 1, x + y FROM {EMB2D} UNION ALL SELECT id, 'MULTIPOINT', 2, x + y FROM {EMB2D}
  UNION ALL SELECT id, 'MULTILINESTRING', 2, 2 * x + 2 * y FROM {EMB2D} UNION ALL SELECT id, 'GEOMETRYCOLLECTION', 2, 2 * x + y FROM {EMB2D})""")
def wkt_kinds(spark, d):
    """Texts of several kinds of geometry, read back: the number of parts and the sum of all x."""
    p = emb2d(spark, d)
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    text = lambda *parts: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in parts])
    texts = [
        text("POINT (", x, " ", y, ")"), text("LINESTRING(", x, " ", y, ", ", y, " ", x, ")"), text("MULTIPOINT (", x, " ", y, ", ", y, " ", x, ")"),
        text("MULTILINESTRING ((", x, " ", y, ",", y, " ", x, "), (", x, " ", y, ",", y, " ", x, "))"), text("GEOMETRYCOLLECTION (POINT (", x, " ", y, "), LINESTRING (", x, " 0, ", y, " 1))"),
    ]
    read = p.select("id", F.explode(F.array(*texts)).alias("t")).select("id", geometry.read_wkt_parts(F.col("t")).alias("g"))
    total = F.aggregate(F.flatten("g.parts"), F.lit(0.0), lambda s, q: s + q["x"])
    return read.select("id", "g.kind", F.size("g.parts").alias("n"), F.round(total, 4).alias("sx"))


@query(f"SELECT objectid, true AS same, false AS moved FROM {_RINGS}")
def ring_equality(spark, d):
    """Each ring, written and read back with its first place repeated at the end, is the same; moved by one degree it isn't."""
    r = _rings(spark, d)
    closed = F.concat("ring", F.array(F.element_at("ring", 1)))
    moved = F.transform("ring", lambda p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y")))
    opened = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(closed)
    return r.select("objectid", geometry.same_ring(F.col("ring"), opened).alias("same"), geometry.same_ring(F.col("ring"), moved).alias("moved"))


# bins, subsets and graphs ---------------------------------------------------------------------------------------------


@query(f"""WITH v AS (SELECT x FROM {CUST2D} WHERE x BETWEEN -10 AND 100), m AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM v),
  h AS (SELECT CASE WHEN x = 100 THEN 22 ELSE CAST(floor((x + 10) / 5) + 1 AS INTEGER) END AS bin, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY 1),
  q AS (SELECT b AS bin, exp(-pow((-10 + (b - 0.5) * 5 - m) / s, 2) / 2) AS q FROM range(1, 23) t(b), m)
  SELECT round(sum(n / t * ln(n / t / (q / w))), 7) AS kl FROM h JOIN q USING (bin), (SELECT sum(n) AS t FROM h), (SELECT sum(q) AS w FROM q)""")
def normality_score(spark, d):
    return partitioning.normality(cust2d(spark, d), "x", -10, 100, 22).select(F.round("kl", 7).alias("kl"))


@query(f"""WITH b AS (SELECT label AS s, CAST(floor(x / 0.05) AS BIGINT) * 1000 + CAST(floor(y / 0.05) AS BIGINT) AS bin FROM {EMB2D}), n AS (SELECT s, bin, count(*) AS n FROM b GROUP BY ALL), z AS (SELECT s, sum(n) AS size FROM n GROUP BY s)
  SELECT p.s AS a, q.s AS b, round(2 * sum(least(p.n, q.n)) / any_value(zp.size + zq.size), 8) AS f_measure FROM n p JOIN n q ON p.bin = q.bin AND p.s < q.s JOIN z zp ON zp.s = p.s JOIN z zq ON zq.s = q.s GROUP BY 1, 2""")
def bin_f_measure(spark, d):
    bins = emb2d(spark, d).withColumn("bin", F.floor(F.col("x") / 0.05) * 1000 + F.floor(F.col("y") / 0.05))
    return partitioning.bin_overlap(bins, "label").withColumn("f_measure", F.round("f_measure", 8))


@query(f"""WITH {_CONT}, f AS (SELECT c.t, c.p, 2 * c.n / CAST(a.a + b.b AS DOUBLE) AS f1 FROM c JOIN a USING (t) JOIN b USING (p))
  SELECT t AS true_label, p AS pred_label, round(f1, 9) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY t ORDER BY f1 DESC, p) = 1""")
def subset_match(spark, d):
    return evaluate.subset_match(_labels(spark, d)).withColumn("f1", F.round("f1", 9))


@query(f"""WITH {_CONT}, g AS (SELECT t, max(CASE WHEN p = 0 THEN n ELSE 0 END) AS n0, max(CASE WHEN p = 1 THEN n ELSE 0 END) AS n1, max(CASE WHEN p = 2 THEN n ELSE 0 END) AS n2, max(CASE WHEN p = 3 THEN n ELSE 0 END) AS n3 FROM c GROUP BY t)
  SELECT round(max(w.n0 + x.n1 + y.n2 + z.n3) / CAST((SELECT sum(n) FROM c) AS DOUBLE), 9) AS accuracy FROM g w, g x, g y, g z WHERE w.t <> x.t AND w.t <> y.t AND w.t <> z.t AND x.t <> y.t AND x.t <> z.t AND y.t <> z.t""")
def best_accuracy(spark, d):
    """The accuracy of the best one-to-one match of 5 classes and 4 groups; SQL tries all of them."""
    return evaluate.matched_accuracy(_labels(spark, d)).agg(F.round(F.max("accuracy"), 9).alias("accuracy"))


_GA = f"(SELECT id AS src, (id * 7 + 3) % 500 + 1 AS dst, 0.2 + (id % 7) / 10.0 AS w FROM {EMB2D})"
_GB = f"(SELECT id AS src, CASE WHEN id % 2 = 0 THEN (id * 7 + 3) % 500 + 1 ELSE (id * 5 + 1) % 500 + 1 END AS dst, 0.3 + (id % 5) / 10.0 AS w FROM {EMB2D})"


def _two_graphs(spark, d):
    p = emb2d(spark, d).select("id")
    far, other = (F.col("id") * 7 + 3) % 500 + 1, (F.col("id") * 5 + 1) % 500 + 1
    a = p.select(F.col("id").alias("src"), far.alias("dst"), (F.lit(0.2) + (F.col("id") % 7) / 10.0).alias("w"))
    return a, p.select(F.col("id").alias("src"), F.when(F.col("id") % 2 == 0, far).otherwise(other).alias("dst"), (F.lit(0.3) + (F.col("id") % 5) / 10.0).alias("w"))


@query(f"""WITH a AS {_GA}, b AS {_GB}, la AS (SELECT greatest(min(w) / 2, 1e-8) AS v FROM a), lb AS (SELECT greatest(min(w) / 2, 1e-8) AS v FROM b)
  SELECT src, dst, round(CAST(coalesce(a.w, la.v) * pow(coalesce(b.w, lb.v), 0.25 / 0.75) AS DOUBLE), 9) AS w FROM a FULL JOIN b USING (src, dst), la, lb""")
def graph_intersection(spark, d):
    return graph.intersect_graphs(*_two_graphs(spark, d), 0.25).withColumn("w", F.round("w", 9))


@query(f"""WITH a AS {_GA}, s AS (SELECT src, dst, CAST(w AS DOUBLE) / max(w) OVER (PARTITION BY src) AS w FROM a), r AS (SELECT dst AS src, src AS dst, w AS v FROM s)
  SELECT src, dst, round(coalesce(w, 0) + coalesce(v, 0) - coalesce(w, 0) * coalesce(v, 0), 9) AS w FROM s FULL JOIN r USING (src, dst)""")
def local_connectivity(spark, d):
    return graph.reset_local_connectivity(_two_graphs(spark, d)[0]).withColumn("w", F.round("w", 9))


@query(f"""WITH a AS {_GA} SELECT src, dst, round(CAST(w * CASE WHEN la.label IS NULL OR lb.label IS NULL THEN exp(-1.0) WHEN la.label <> lb.label THEN exp(-5.0) ELSE 1.0 END AS DOUBLE), 9) AS w
  FROM a JOIN {EMB2D} la ON la.id = src JOIN {EMB2D} lb ON lb.id = dst""")
def graph_by_category(spark, d):
    return graph.by_category(_two_graphs(spark, d)[0], emb2d(spark, d).select("id", "label")).withColumn("w", F.round("w", 9))


@query(f"WITH a AS {_GA} SELECT src, dst, round(CASE WHEN 200 * w / (max(w) OVER ()) >= 1 THEN (max(w) OVER ()) / CAST(w AS DOUBLE) END, 9) AS every FROM a")
def epochs_per_sample(spark, d):
    return graph.epochs_per_sample(_two_graphs(spark, d)[0], 200).select("src", "dst", F.round("every", 9).alias("every"))


@query(f"SELECT count(*) AS n, true AS apart FROM {CUST2D}")
def hilbert_ordered(spark, d):
    """Rows placed along the curve: no two partitions overlap."""
    p = partitioning.hilbert_ordered(cust2d(spark, d), 6).withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n"))
    a, b = p.alias("a"), p.alias("b")
    clash = a.join(b, (F.col("a.part") < F.col("b.part")) & (F.col("a.hi") >= F.col("b.lo"))).agg(F.count(F.lit(1)).alias("c"))
    return p.agg(F.sum("n").alias("n")).crossJoin(F.broadcast(clash)).select("n", (F.col("c") == 0).alias("apart"))


@query(f"SELECT id, label FROM {EMB2D}")
def clusters_file_roundtrip(spark, d):
    at = new_path(spark, "written")
    files.write_clusters(emb2d(spark, d).select("id", "label"), at)
    return spark.read.csv(at, sep="\t", header=True, schema="id long, label int").select("id", "label")


@query(f"SELECT id, x + y AS total FROM {EMB2D}")
def mapped_file_roundtrip(spark, d):
    """Lines through a mapper that adds up two numbers."""
    at = new_path(spark, "lines")
    emb2d(spark, d).select(F.concat_ws(";", F.col("id").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"))).write.text(at)

    def mapper(batches):
        for b in batches:
            parts = [line.split(";") for line in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(p[0]) for p in parts], pa.int64()), pa.array([float(p[1]) + float(p[2]) for p in parts], pa.float64())], ["id", "total"])

    return files.read_mapped(spark, at, mapper, "id long, total double")


# approximate searches, and invariants of what SQL can't compute ---------------------------------------------------------


def _enough(found, exact, least):
    return neighbors.recall(found, exact).select((F.col("recall") >= least).alias("enough"))


@query("SELECT true AS enough")
def knn_forest_recall(spark, d):
    """Four trees of leaves of 256 find 95 % of the true neighbours or more."""
    p = cust2d(spark, d)
    return _enough(neighbors.knn_forest(p, K, leaf_rows=256), neighbors.knn(p, K), 0.95)


@query("SELECT true AS enough")
def knn_descent_recall(spark, d):
    """Two trees of leaves of 64, bettered twice by the neighbours' neighbours, find 98 % or more."""
    p = cust2d(spark, d)
    return _enough(neighbors.knn_descent(p, neighbors.knn_forest(p, K, trees=2, leaf_rows=64), K), neighbors.knn(p, K), 0.98)


@query(f"SELECT count(*) AS n, true AS uncorrelated, true AS ordered FROM {EMB2D}")
def pca_invariants(spark, d):
    """Scores of the first two components: uncorrelated, and no single column varies more than the first."""
    v = emb64(spark, d)
    pcs, _, _ = prep.principal_components(v, "vec", 2)
    s = pcs.agg(F.count(F.lit(1)).alias("n"), F.corr(F.get("pc", 0), F.get("pc", 1)).alias("r"), F.var_samp(F.get("pc", 0)).alias("v1"), F.var_samp(F.get("pc", 1)).alias("v2"))
    most = v.select(F.posexplode("vec").alias("i", "e")).groupBy("i").agg(F.var_samp("e").alias("v")).agg(F.max("v").alias("m"))
    return s.crossJoin(F.broadcast(most)).select("n", (F.abs("r") < 1e-9).alias("uncorrelated"), ((F.col("v1") >= F.col("v2")) & (F.col("v1") >= F.col("m") - 1e-12)).alias("ordered"))


def _parted(spark, d, cells):
    """Whether cells hold each point once and none more than twice its share."""
    t = partitioning.cell_table(cells)
    return t.agg(F.sum("n").alias("n"), (F.max("n") <= 2.0 * F.sum("n") / F.count(F.lit(1)) + 20).alias("even"))


for _name, _make in {
    "partition_hilbert_even": lambda p: partitioning.hilbert_parts(p, 8),
    "partition_kd_even": lambda p: partitioning.place(p, partitioning.kd_cells(p, 8)[0]),
    "partition_str_even": lambda p: partitioning.str_parts(p, 9),
}.items():
    QUERIES[_name] = lambda spark, d, make=_make: _parted(spark, d, make(cust2d(spark, d)))
    ORACLE[_name] = f"SELECT CAST(count(*) AS BIGINT) AS n, true AS even FROM {CUST2D}"


@query(f"SELECT count(*) AS n, true AS halves FROM {CUST2D}")
def probability_bins_even(spark, d):
    """Recursive median splits to depth 4: sixteen bins that differ little in size."""
    t = partitioning.bin_table(partitioning.probability_bins(cust2d(spark, d), 4))
    return t.agg(F.sum("n").alias("n"), ((F.count(F.lit(1)) == 16) & (F.max("n") - F.min("n") <= 32)).alias("halves"))


@query(f"SELECT count(*) AS n, true AS scaled FROM {EMB2D}")
def hull_norms(spark, d):
    """Volumes over gamma(d) instead of gamma(d - 1) scale the hull score in three dimensions by a quarter."""
    p = emb3d(spark, d)
    e = neighbors.knn(p, K, dims=["x", "y", "z"])
    a, b = (centrality.dcm_hull(e, p, ["x", "y", "z"], norm=n) for n in (1, 0))
    both = a.join(b.select("id", F.col("dcm").alias("other")), "id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("dcm") == 1) | (F.abs(F.col("dcm") / 4 - F.col("other")) < 1e-9)).alias("scaled"))


@query(f"SELECT count(*) AS n, count(*) AS ids FROM {EMB2D}")
def cluster_embedded(spark, d):
    """Vectors of 64 components clustered by their first two principal ones: each has one cluster."""
    got = cluster.cluster_embedded(emb64(spark, d), K, 0.7, "vec")
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query(f"SELECT count(*) AS n, true AS modular FROM {EMB2D}")
def graph_communities(spark, d):
    """Communities of the shared-neighbour graph: every point has one, and the modularity is above 0.5."""
    edges = neighbors.shared_neighbours(neighbors.knn(emb2d(spark, d), K), K).select("src", "dst", "weight")
    found = communities.communities(edges)
    q = communities.modularity(edges, found)
    return found.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(q)).select("n", (F.col("modularity") > 0.5).alias("modular"))
