"""Parsing, filling and the dual-tree join on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marchland.functions import trees
from marchland.operators import badrows, spatial
from marchland.operators.fill import Features, Target, fill_missing

GOOD_B, GOOD_D = "1,2,3,4,5,6,7,8,9,10,2", ",".join(["1"] * 33 + ["40", "6"])
CASES = [
    ("BreastCancer-1.csv", GOOD_B, None, None),
    ("BreastCancer-1.csv", GOOD_B + "\r", None, None),
    ("BreastCancer-1.csv", ' 1 ,"2",03, 4.0,5,6,?,8.00,9,10,"1"', None, None),
    ("BreastCancer-1.csv", "1,2,3,4,5,6,,8,9,10,2", None, None),
    ("BreastCancer-1.csv", '1,2,3,4,5,6,"",8,9,10,2', None, None),
    ("BreastCancer-1.csv", "1,2,3,4,5,6, ?,8,9,10,2", None, None),
    ("Dermatology-1.csv", GOOD_D, None, None),
    ("Dermatology-1.csv", GOOD_D.replace("40", "?"), None, None),
    ("BreastCancer-1.csv", "1,2,3,4,5,6,7,8,9,10", "field_count", "c10"),
    ("BreastCancer-1.csv", GOOD_B + ",2", "field_count", "end_of_line"),
    ("BreastCancer-1.csv", GOOD_B + "\r\r", "invalid_value", "c10"),
    ("BreastCancer-1.csv", "1,2,3,4,5,6,11,8,9,10,2", "invalid_value", "c6"),
    ("BreastCancer-1.csv", "1,2,3,4,5,6,??,8,9,10,2", "invalid_value", "c6"),
    ("BreastCancer-1.csv", "1,2,3,4,5,\t?,7,8,9,10,2", "invalid_value", "c5"),
    ("BreastCancer-1.csv", '1,2,3,4,5,6,"7,8,9,10,2', "broken_quotes", "c6"),
    ("BreastCancer-1.csv", '1,2,3,4,5,6,"7"x,8,9,10,2', "broken_quotes", "c6"),
    ("BreastCancer-1.csv", '1,2,3,4,5,6,"7,5",8,9,10,2', "invalid_value", "c6"),
    ("BreastCancer-1.csv", '1,2,3,4,5,6,"7""",8,9,10,2', "invalid_value", "c6"),
    ("BreastCancer-1.csv", "", "blank", "c0"),
    ("BreastCancer-1.csv", " \t ", "blank", "c0"),
    ("BreastCancer-1.csv", None, "null_line", None),
    ("BreastCancer-1.csv", GOOD_B.replace(",", ";"), "field_count", "c0"),
    ("BreastCancer-1.csv", "١" + GOOD_B[1:], "invalid_value", "c0"),
    ("Dermatology-1.csv", GOOD_D.replace("40", "0"), "invalid_value", "c33"),
    ("Dermatology-1.csv", ",".join(["1"] * 10 + ["2"] + ["1"] * 22 + ["40", "6"]), "invalid_value", "c10"),
    ("Other.csv", GOOD_B, "unknown_kind", None),
    (None, GOOD_B, "unknown_kind", None),
    ("BreastCancer-1.csv", '"' + '""' * 200_000, "broken_quotes", "c0"),
    ("BreastCancer-1.csv", "1" * 300_000 + ",x", "field_count", "c1"),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, n, t, "kept") for i, (n, t, _, _) in enumerate(CASES)], "line_id long, file_name string, line_text string, kind2 string")
    got = {r["line_id"]: (r["reason"], r["broken_field"]) for r in badrows.bad_lines(df).collect()}
    assert got == {i: (reason, field) for i, (_, _, reason, field) in enumerate(CASES) if reason}
    rows = badrows.typed_rows(df, "BreastCancer").orderBy("line_id").collect()
    assert [r["line_id"] for r in rows] == [0, 1, 2, 3, 4, 5] and rows[2]["c3"] == 4 and rows[2]["c6"] is None and rows[0]["c10"] == 2
    assert badrows.bad_lines(df.limit(0)).count() == 0


def test_first_broken_field_of_each_position(spark):
    lines = []
    for i in range(11):
        parts = GOOD_B.split(",")
        parts[i] = "x"
        lines.append((i, "BreastCancer.csv", ",".join(parts)))
    got = {r["line_id"]: r["broken_field"] for r in badrows.bad_lines(spark.createDataFrame(lines, "line_id long, file_name string, line_text string")).collect()}
    assert got == {i: f"c{i}" for i in range(11)}


POINTS = "pt_id long, lat double, lon double, _tile string"


def brute(rows, radius):
    rows = sorted({r[:3] for r in rows if None not in r[:3]})
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] != b[0] and trees.arc(np.array(a[1]), np.array(a[2]), np.array(b[1]), np.array(b[2])) <= radius:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


@pytest.mark.parametrize("tile_rows", [40_000, 15])
def test_near_pairs(spark, tile_rows):
    rng = np.random.default_rng(5)
    rows = [(i, 30 + float(y), 110 + float(x), "t") for i, (x, y) in enumerate(rng.random((300, 2)) * 0.01)]
    rows += [(1000 + i, 30.005, 110.005, "t") for i in range(30)] + [(2000, 10.0, 179.9999, "t"), (2001, 10.0, -179.9999, "t"), (2002, 89.9999, 10.0, "t"), (2003, 89.9999, -170.0, "t")]
    rows += rows[:20] + [(5000, None, 110.0, "t"), (5001, float("nan"), 110.0, "t"), (5002, 95.0, 110.0, "t"), (None, 30.0, 110.0, "t")]
    got = spatial.dual_tree_join(spark.createDataFrame(rows, POINTS), 50.0, tile_rows=tile_rows).collect()
    pairs = [(r["a_id"], r["b_id"]) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute([r for r in rows if r[0] is not None and r[0] < 5000], 50.0)


def square(x, y, s):
    x, y, s = float(x), float(y), float(s)
    return [[x, y], [x + s, y], [x + s, y], [x + s, y + s], [x, y + s]]


REGIONS = "objectid long, shape_area double, coordinates array<array<array<double>>>"


def test_hot_place_is_cut_into_chunks(spark):
    rows = [(i, 30.0, 110.0, "") for i in range(1000)] + [(2000 + i, 30.0002, 110.0, "") for i in range(50)]
    df = spark.createDataFrame(rows, POINTS)
    assert spatial.dual_tree_join(df, 50.0, tile_rows=100).count() == 1050 * 1049 // 2
    slim = df.selectExpr("pt_id AS _id", "lat AS _lat", "lon AS _lon")
    tiled, _ = spatial._tiled(slim, 50.0, 0.05, 100)
    sizes = [r["count"] for r in tiled.groupBy("_tile").count().collect()]
    chunks = 11
    assert max(sizes) <= 300 and sum(sizes) == 1050 * chunks


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_regions(spark, most):
    regions = [(1, 100.0, [square(0, 0, 10), square(4, 4, 2)]), (2, 1.0, [square(8, 8, 4)]), (3, None, [square(0, 0, 20)]), (4, 5.0, None), (5, 5.0, [[[0.0, 0.0], [1.0, 1.0]]]), (1, 100.0, [square(0, 0, 10), square(4, 4, 2)])]
    points = [(1, 1.0, 1.0, ""), (2, 5.0, 5.0, ""), (3, 9.0, 9.0, ""), (4, 15.0, 15.0, ""), (5, 50.0, 50.0, ""), (1, 1.0, 1.0, "")]
    got = spatial.dual_tree_join(spark.createDataFrame(points, POINTS), None, spark.createDataFrame(regions, REGIONS), shared_vertices=most).collect()
    assert {(r["kind"], r["a_id"], r["b_id"]) for r in got} == {("within", 1, 1), ("within", 3, 2), ("within", 2, 3), ("within", 3, 4)}


def test_nodes_away_from_edges_are_decided_whole():
    rng = np.random.default_rng(2)
    xy = rng.random((5000, 2)) * 12
    order = np.argsort(trees.morton(xy[:, 1], xy[:, 0]))
    x, y = xy[order, 0], xy[order, 1]
    regions = [trees.Region(7, [np.array(square(2.0, 3.0, 5.0)), np.array(square(4.0, 4.0, 1.5))]), trees.Region(8, [np.array([[0, 0], [12, 0], [6, 11.5]], float)])]
    want = np.where(regions[0].holds(x, y), 0, np.where(regions[1].holds(x, y), 1, -1))
    assert (trees.first_region(x, y, regions) == want).all()
    inside = (x > 2) & (x < 7) & (y > 3) & (y < 8) & ~((x > 4) & (x < 5.5) & (y > 4) & (y < 5.5))
    assert (regions[0].holds(x, y) == inside).all()


def test_empty_points(spark):
    assert spatial.dual_tree_join(spark.createDataFrame([], POINTS), 50.0, spark.createDataFrame([], REGIONS)).count() == 0


FILL = "rec_id long, grp long, a double, b double, kind string, t double, g__cluster string"


def test_fill(spark):
    rows = [(i, i // 5, float(i % 2) * 10, 0.0, "xy"[i % 2], None if i % 11 == 3 else float(i % 2) * 4 + 1, "clash") for i in range(60)]
    rows += [rows[3], (100, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, FILL)
    targets = [Target("t", F.col("t"), (("group_cluster", ("grp", "_cluster"), 1), ("cluster", ("_cluster",), 1), ("all", (), 1))), Target("kind", F.col("kind"), (("cluster", ("_cluster",), 1), ("all", (), 1)), categorical=True)]
    got = {r["rec_id"]: r for r in fill_missing(df, "rec_id", Features({"a": F.col("a"), "b": F.col("b")}, {"kind": F.col("kind")}), targets, k=2).collect()}
    assert len(got) == 61
    for i in range(60):
        assert got[i]["t"] == float(i % 2) * 4 + 1 and (got[i]["t_method"] is not None) == (i % 11 == 3) and got[i]["kind_method"] is None
    assert got[100]["t_method"] in ("cluster", "all") and got[100]["kind"] in "xy"


def test_fill_nothing_known_and_empty(spark):
    t = [Target("t", F.col("t"), (("all", (), 1),))]
    none = fill_missing(spark.createDataFrame([(1, 1, 1.0, 1.0, "x", None, "")], FILL), "rec_id", Features({"a": F.col("a")}), t).collect()
    assert [(r["t"], r["t_method"]) for r in none] == [(None, "none")]
    assert fill_missing(spark.createDataFrame([], FILL), "rec_id", Features({"a": F.col("a")}), t).count() == 0
