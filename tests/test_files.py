"""Readers, writers, partitions and streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from marchland.functions import geometry
from marchland.operators import partitioning
from marchland.sources import points, shapefile
from marchland.sources.wkb import parse_wkb
from marchland.streaming.assign import assign_stream, read_point_files, windowed_counts


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_whitespace_and_delimited(spark, tmp_path):
    at = put(tmp_path, "a.txt", "1.5\t2 \t3\t\n 4 5 NaN\nx y 1\n\n7 8\n")
    assert [tuple(r)[:3] for r in points.read_whitespace(spark, at).collect()] == [(1.5, 2.0, 3), (4.0, 5.0, None), (7.0, 8.0, None)]
    at = put(tmp_path, "b.txt", "n|1|2|z\nbad\nm|3|4|\n")
    rows = points.read_delimited(spark, at, "pipe", 1).collect()
    assert [(r["x"], r["y"], r["attributes"]) for r in rows] == [(1, 2, ["n", "z"]), (3, 4, ["m", ""])]
    at = put(tmp_path, "c.txt", "3,4,1,2\n")
    assert tuple(points.read_rectangles(spark, at).drop("id").first()) == (1, 2, 3, 4)


def test_text_geometries(spark, tmp_path):
    at = put(tmp_path, "w.txt", "POINT (1 -2.5e1)\npolygon ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))\nLINE\n")
    rows = points.read_wkt(spark, at).collect()
    assert len(rows) == 2 and tuple(rows[0]["point"]) == (1, -25) and len(rows[1]["rings"]) == 2 and tuple(rows[1]["rings"][0][1]) == (4, 0)
    assert points.read_wkt(spark, at, invalid="keep").count() == 3
    with pytest.raises(Exception):
        points.read_wkt(spark, at, invalid="fail").collect()
    feature = {"type": "Feature", "properties": {"name": "n"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    at = put(tmp_path, "g.json", json.dumps(feature) + "\n{}\n")
    row = points.read_geojson(spark, at, "name: string").collect()
    assert len(row) == 1 and json.loads(row[0]["coordinates"]) == [1, 2] and row[0]["properties"]["name"] == "n"
    at = put(tmp_path, "f.json", json.dumps({"type": "FeatureCollection", "features": [feature, feature]}, indent=1))
    assert points.read_geojson(spark, at, whole_file=True).count() == 2


def test_binary_geometries(spark, tmp_path):
    square = struct.pack("<BIII", 1, 3, 1, 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    multi = struct.pack(">BII", 0, 4, 2) + b"".join(struct.pack(">BIdd", 0, 1, i, -i) for i in (1, 2))
    assert parse_wkb(square) == ("POLYGON", [[[0, 0], [1, 0], [1, 1], [0, 0]]]) and parse_wkb(multi)[1] == [[[1, -1]], [[2, -2]]]
    assert parse_wkb(square[:-1]) is None and parse_wkb(b"") is None and parse_wkb(square + b"x") is None
    at = put(tmp_path, "b.txt", square.hex() + "\n" + multi.hex() + "\nzz\n")
    got = points.read_wkb(spark, at)
    assert [r["kind"] for r in got.collect()] == ["POLYGON", "MULTIPOINT"] and points.explode_parts(got).count() == 3


def test_shapefile(spark, tmp_path):
    body = struct.pack("<i4dii", 5, 0, 0, 2, 2, 1, 4) + struct.pack("<i", 0) + struct.pack("<8d", 0, 0, 2, 0, 2, 2, 0, 0)
    dot = struct.pack("<idd", 1, 5, 6)
    records = b"".join(struct.pack(">ii", i + 1, len(b) // 2) + b for i, b in enumerate((body, dot)))
    (tmp_path / "lay.shp").write_bytes(b"\0" * 36 + struct.pack("<4d", 0, 0, 5, 6) + b"\0" * 32 + records)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15
    (tmp_path / "lay.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", 2, 32 + 32 + 1, 6) + b"\0" * 20 + field + b"\r" + b" one  " + b" two  ")
    rows = shapefile.read_shapefile(spark, str(tmp_path)).orderBy("record").collect()
    assert [(r["kind"], r["attributes"]["NAME"]) for r in rows] == [("POLYGON", "one"), ("POINT", "two")] and rows[0]["parts"][0][1] == [2, 0]
    assert tuple(shapefile.read_bounds(spark, str(tmp_path)).first()) == (0, 0, 5, 6)
    assert [tuple(r) for r in shapefile.read_fields(spark, str(tmp_path)).collect()] == [("lay", "NAME")]


def test_matrices(spark, tmp_path):
    at = put(tmp_path, "m.csv", "X,g1,g.2\nc1,0,2\nc2,3,0\n")
    assert {tuple(r) for r in points.read_matrix_csv(spark, at).collect()} == {("c1", "g.2", 2.0), ("c2", "g1", 3.0)}
    m, g, c = put(tmp_path, "m.mtx", "%%MatrixMarket\n2 2 2\n2 1 2\n1 2 3\n"), put(tmp_path, "g.tsv", "g1\tA\ng2\tB\n"), put(tmp_path, "c.tsv", "c1\nc2\n")
    assert {tuple(r) for r in points.read_matrix_market(spark, m, g, c).collect()} == {("c1", "g2", 2.0), ("c2", "g1", 3.0)}
    meta = spark.createDataFrame([("a-1", "k"), ("b-1", None)], "barcode string, class string")
    assert points.join_barcodes(meta, spark.createDataFrame([("a.1", 1.0), ("b.1", 2.0)], "barcode string, u double")).count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, -2.0, "n"), (2, 3.0, 4.0, "m")], "id long, x double, y double, name string")
    points.write_wkt(df, str(tmp_path / "w"))
    assert {tuple(r["point"]) for r in points.read_wkt(spark, str(tmp_path / "w")).collect()} == {(1.5, -2.0), (3.0, 4.0)}
    points.write_wkb(df, str(tmp_path / "b"))
    assert sorted(r["parts"][0][0] for r in points.read_wkb(spark, str(tmp_path / "b")).collect()) == [[1.5, -2.0], [3.0, 4.0]]
    points.write_geojson(df, str(tmp_path / "g"), properties=("name",))
    assert {r["properties"]["name"] for r in points.read_geojson(spark, str(tmp_path / "g"), "name: string").collect()} == {"n", "m"}
    points.append_scores(df, str(tmp_path / "s")), points.append_scores(df, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 4
    points.split_files(df.coalesce(1), str(tmp_path / "p"), 1)
    assert len(list((tmp_path / "p").glob("part-*"))) == 2


def test_hilbert_is_a_walk(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    got = sorted((r["h"], r["x"], r["y"]) for r in df.withColumn("h", geometry.hilbert(F.col("x"), F.col("y"), 3)).collect())
    assert [g[0] for g in got] == list(range(64))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:]))


def test_partitions_hold_all_points_evenly(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(800, 2)))], "id long, x double, y double")
    kd, quad = partitioning.kd_cells(df, 8)[0], partitioning.quad_cells(df, 8)
    for placed, most in ((partitioning.place(df, kd), 140), (partitioning.place(df, quad), 110), (partitioning.str_parts(df, 9), 110), (partitioning.hilbert_parts(df, 8), 120), (partitioning.equal_grid(df, 9), 800)):
        sizes = [r["n"] for r in partitioning.cell_table(placed).collect()]
        assert sum(sizes) == 800 and max(sizes) <= most
    outside = partitioning.place(df, [(-0.1, -0.1, 0.1, 0.1)])
    assert outside.where("cell = 1").count() > 700
    with pytest.raises(ValueError):
        partitioning.sample_rate(10, 6)


def test_circles_and_rings(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    lit = F.lit
    assert value(geometry.in_ring(lit(1.0), lit(1.0), ring)) and not value(geometry.in_ring(lit(5.0), lit(1.0), ring))
    assert value(geometry.circle_meets_ring(lit(5.0), lit(2.0), lit(1.0), ring)) and not value(geometry.circle_meets_ring(lit(5.5), lit(2.0), lit(1.0), ring))
    assert value(geometry.circle_covers_all(lit(2.0), lit(2.0), lit(3.0), ring)) and not value(geometry.circle_covers_all(lit(2.0), lit(2.0), lit(2.0), ring))
    assert value(geometry.circle_meets_segment(lit(0.0), lit(1.0), lit(1.0), lit(-1.0), lit(0.0), lit(1.0), lit(0.0))) and value(geometry.envelope(ring))["xmax"] == 4


def test_streams(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    new = spark.createDataFrame([(1, 0.1, 0.0), (1, 0.1, 0.0), (2, 9.0, 9.0), (3, 500.0, 0.0)], "id long, x double, y double").withColumn("ts", F.lit("2024-01-01 00:10:00").cast("timestamp"))
    new.write.parquet(str(inbox))
    base = spark.createDataFrame([(1, 0.0, 0.0, 5), (2, 9.0, 9.1, 6)], "id long, x double, y double, cluster int")
    assign_stream(read_point_files(spark, str(inbox)), base, out, str(tmp_path / "state"), within=50.0).awaitTermination()
    assert {(r["id"], r["cluster"]) for r in spark.read.parquet(out).collect()} == {(1, 5), (2, 6), (3, 0)}
    counts = windowed_counts(read_point_files(spark, str(inbox)), 10.0)
    counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s2")).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(str(tmp_path / "w"))).start().awaitTermination()
    assert {(r["cx"], r["n"]) for r in spark.read.parquet(str(tmp_path / "w")).collect()} == {(0, 3), (50, 1)}
