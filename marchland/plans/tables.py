"""Queries of partitions, bins, graphs, files and streams, with their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marchland.functions import geometry
from marchland.operators import graph, neighbors, partitioning, prep
from marchland.plans.load import table
from marchland.plans.points import CUST2D, EMB2D, cust2d, emb2d, emb64
from marchland.session import new_path
from marchland.sources import points as files
from marchland.sources.wkb import parsed, point_hex
from marchland.streaming import assign

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


_AXIS = "least(3, CAST(floor(({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ()) * 4) AS BIGINT))"


@query(f"SELECT id, {_AXIS.format('x')} * 4 + {_AXIS.format('y')} AS cell FROM {CUST2D}")
def partition_equal_grid(spark, d):
    return partitioning.equal_grid(cust2d(spark, d), 16).select("id", "cell")


def _hilbert_sql(bits: int) -> str:
    """The curve's place of a cell, one CTE a bit."""
    n = 1 << bits
    ax = "least({n} - 1, CAST(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * {n}) AS BIGINT))"
    out = [f"s{bits} AS (SELECT id, {ax.format(n=n, c='x')} AS x, {ax.format(n=n, c='y')} AS y, CAST(0 AS BIGINT) AS d FROM {CUST2D})"]
    for b in range(bits - 1, -1, -1):
        s = 1 << b
        out.append(f"t{b} AS (SELECT id, x % {2 * s} >= {s} AS rx, y % {2 * s} >= {s} AS ry, x % {s} AS x, y % {s} AS y, d FROM s{b + 1})")
        flip = lambda c: f"CASE WHEN rx THEN {s - 1} - {c} ELSE {c} END"
        out.append(f"s{b} AS (SELECT id, CASE WHEN ry THEN x ELSE {flip('y')} END AS x, CASE WHEN ry THEN y ELSE {flip('x')} END AS y, d + {s * s} * CASE WHEN rx AND ry THEN 2 WHEN rx THEN 3 WHEN ry THEN 1 ELSE 0 END AS d FROM t{b})")
    return "WITH " + ", ".join(out) + " SELECT id, d AS h FROM s0"


@query(_hilbert_sql(15))
def hilbert_codes(spark, d):
    return partitioning.hilbert_code(cust2d(spark, d), 15).select("id", "h")


@query(f"WITH p AS {CUST2D} SELECT id FROM p")
def hilbert_roundtrip(spark, d):
    """Ids of the points whose cell comes back from its place along the curve: all of them."""
    p = prep.extent(cust2d(spark, d)).first()
    cells = cust2d(spark, d).select("id", geometry.axis_cell(F.col("x"), p["xmin"], p["xmax"], 8).alias("cx"), geometry.axis_cell(F.col("y"), p["ymin"], p["ymax"], 8).alias("cy"))
    back = cells.withColumn("b", geometry.hilbert_cell(geometry.hilbert(F.col("cx"), F.col("cy"), 8), 8))
    return back.where((F.col("b.x") == F.col("cx")) & (F.col("b.y") == F.col("cy"))).select("id")


@query()
def partition_hilbert(spark, d):
    return partitioning.cell_table(partitioning.hilbert_parts(cust2d(spark, d), 8))


@query()
def partition_kd(spark, d):
    p = cust2d(spark, d)
    return partitioning.cell_table(partitioning.place(p, partitioning.kd_cells(p, 8)[0]))


@query()
def partition_quad(spark, d):
    p = cust2d(spark, d)
    return partitioning.cell_table(partitioning.place(p, partitioning.quad_cells(p, 8)))


@query()
def partition_str(spark, d):
    return partitioning.cell_table(partitioning.str_parts(cust2d(spark, d), 9))


@query(f"""WITH p AS {CUST2D} SELECT p.id, s.id AS cell FROM p JOIN p s ON s.id <= 8
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), -s.id) = 1""")
def partition_voronoi(spark, d):
    """The seeds are the points 1 to 8."""
    p = cust2d(spark, d)
    return partitioning.voronoi_parts(p, p.where("id <= 8")).select("id", "cell")


@query()
def probability_bins(spark, d):
    return partitioning.bin_table(partitioning.probability_bins(cust2d(spark, d), 4))


@query(f"SELECT CASE WHEN x = 100 THEN 22 ELSE CAST(floor((x + 10) / 5) + 1 AS INTEGER) END AS bin, count(*) AS n FROM {CUST2D} WHERE x BETWEEN -10 AND 100 GROUP BY 1")
def histogram(spark, d):
    return partitioning.histogram(cust2d(spark, d), "x", -10, 100, 22)


@query(f"""WITH h AS (SELECT CASE WHEN x = 100 THEN 22 ELSE CAST(floor((x + 10) / 5) + 1 AS INTEGER) END AS bin, CAST(count(*) AS DOUBLE) AS n FROM {CUST2D} WHERE x BETWEEN -10 AND 100 GROUP BY 1)
  SELECT round(sum(n / t * ln(n / t * 22)), 8) AS kl FROM h, (SELECT sum(n) AS t FROM h)""")
def uniformity_score(spark, d):
    return partitioning.uniformity(cust2d(spark, d), "x", -10, 100, 22).select(F.round("kl", 8).alias("kl"))


@query(f"SELECT label, count(*) AS n, round(avg(x), 8) AS mean_x, round(avg(y), 8) AS mean_y, round(covar_samp(x, x), 8) AS cov_x_x, round(covar_samp(x, y), 8) AS cov_x_y, round(covar_samp(y, y), 8) AS cov_y_y FROM {EMB2D} GROUP BY label")
def class_moments(spark, d):
    m = partitioning.class_moments(emb2d(spark, d), "label")
    return m.select("label", "n", *[F.round(c, 8).alias(c) for c in m.columns[2:]])


@query()
def fuzzy_graph(spark, d):
    return graph.fuzzy_graph(neighbors.knn(emb2d(spark, d), 15), 15)


@query("SELECT vec_id AS id, i - 1 AS gene, round(CAST(ln(1 + v / t * 10000) AS DOUBLE), 6) AS value FROM (SELECT vec_id, i, abs(CAST(embedding[i] AS DOUBLE)) AS v, sum(abs(CAST(embedding[i] AS DOUBLE))) OVER (PARTITION BY vec_id) AS t FROM embeddings, range(1, 65) t(i))")
def log_normalised(spark, d):
    long = emb64(spark, d).select("id", F.posexplode("vec").alias("gene", "value")).withColumn("value", F.abs("value"))
    return prep.log_normalise(long, "id").select("id", F.col("gene").cast("long").alias("gene"), F.round("value", 6).alias("value"))


@query(f"SELECT id, x, y FROM {EMB2D}")
def wkb_roundtrip(spark, d):
    return emb2d(spark, d).select("id", parsed(F.unhex(point_hex(F.col("x"), F.col("y")))).alias("g")).select("id", F.element_at(F.element_at(F.element_at("g.parts", 1), 1), 1).alias("x"), F.element_at(F.element_at(F.element_at("g.parts", 1), 1), 2).alias("y"))


def _written(spark: SparkSession, name: str) -> str:
    return new_path(spark, name)


@query(f"SELECT count(*) AS n, round(sum(x), 6) AS sx, round(sum(y), 6) AS sy, CAST(sum(label) AS BIGINT) AS labels FROM {EMB2D}")
def whitespace_file_roundtrip(spark, d):
    at = _written(spark, "points")
    emb2d(spark, d).select(F.concat_ws("\t", F.col("x").cast("string"), F.col("y").cast("string"), F.col("label").cast("string"))).write.text(at)
    return files.read_whitespace(spark, at).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 6).alias("sx"), F.round(F.sum("y"), 6).alias("sy"), F.sum("label").alias("labels"))


@query("SELECT count(*) AS n, round(sum(lat), 4) AS lat, round(sum(6378137.0 * radians(lon)), 0) AS x FROM (SELECT lat, lon FROM hubei_points WHERE lat BETWEEN 15 AND 55 AND lon BETWEEN 70 AND 140)")
def lat_lon_file_roundtrip(spark, d):
    at = _written(spark, "latlon")
    table(spark, d, "hubei_points").where(F.col("lat").between(15, 55) & F.col("lon").between(70, 140)).select("lat", "lon").write.csv(at)
    return files.read_lat_lon(spark, at).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lat"), 4).alias("lat"), F.round(F.sum("x"), 0).alias("x"))


@query("SELECT event_id % 100 AS cx, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, d):
    """The events as a stream, counted by a key."""
    at, state = _written(spark, "stream"), _written(spark, "state")
    source = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = source.groupBy((F.col("event_id") % 100).alias("cx")).agg(F.count(F.lit(1)).alias("n"))
    counts.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(at)).start().awaitTermination()
    return spark.read.parquet(at)


@query(f"""WITH p AS {EMB2D} SELECT a.id, CAST(b.label AS INTEGER) AS cluster FROM p a JOIN p b ON a.id % 10 = 0 AND b.id % 10 <> 0
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), -b.id) = 1""")
def stream_assign(spark, d):
    """Points with an id divisible by 10 arrive as a stream and join the group of the nearest other point."""
    inbox, out, state = (_written(spark, n) for n in ("inbox", "assigned", "state"))
    p = emb2d(spark, d)
    p.where("id % 10 = 0").select("id", "x", "y", F.current_timestamp().alias("ts")).write.parquet(inbox)
    base = p.where("id % 10 <> 0").select("id", "x", "y", F.col("label").alias("cluster"))
    assign.assign_stream(assign.read_point_files(spark, inbox), base, out, state).awaitTermination()
    return spark.read.parquet(out).select("id", "cluster")
