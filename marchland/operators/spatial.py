"""Points near other points, and the region that contains each point, by a dual-tree join over distributed tasks.

The upper tree nodes are tiles of the globe; a tile with too many points is split into smaller ones. Every point goes to its
own tile and, as a guest, to each tile within the distance. A tile that can't be split any further (many points at one
place) is cut into chunks, and each pair of chunks is a bucket of its own, so that no task holds more than two chunks and the
pairs to look at stay the same. A task joins the tree of its points with itself, or the trees of two chunks with each other
(``functions.trees``).

Regions of bounded size in all are sent to the tasks. Larger sets are joined by the grid level of their boxes, and each
region then meets the points in its box, in chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marchland.functions.trees import EARTH_M, BoxTree, Regions, morton, near_pairs
from marchland.session import Cut, tasks_for

TILE_DEG = 0.05
TILE_ROWS = 40_000
TASK_ROWS = 60_000
MAX_LISTED = 200_000
SHARED_VERTICES = 2_000_000


def _cells(lat: Column, lon: Column, width: float, r_deg: float) -> tuple[Column, Column, Column, Column, Column, Column]:
    """Own cell and the range of cells within the distance; columns may run over the date line and are wrapped later."""
    grow = F.least(F.lit(180.0), F.lit(r_deg * 1.001) / F.greatest(F.lit(1e-9), F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + r_deg)))))
    iy, ix = F.floor((lat + 90) / width), F.floor((lon + 180) / width)
    y0, y1 = F.floor(F.greatest(F.lit(0.0), lat + 90 - r_deg * 1.001) / width), F.floor(F.least(F.lit(180.0), lat + 90 + r_deg * 1.001) / width)
    x0, x1 = F.floor((lon + 180 - grow) / width), F.floor((lon + 180 + grow) / width)
    return iy, ix, y0, y1, x0, x1


def _tiled(points: DataFrame, radius_m: float | None, tile_deg: float, tile_rows: int) -> tuple[DataFrame, int]:
    """(_id, _lat, _lon, _tile, _side, _home) and the number of rows; every row once as home, else as guest. Rows of side 2
    and 3 (a chunk's own bucket) meet all rows of their tile, those of sides 0 and 1 the other side."""
    r_deg = math.degrees((radius_m or 0.0) / EARTH_M)
    width = max(tile_deg, 4 * r_deg)
    across = math.ceil(360 / width)
    iy, ix, y0, y1, x0, x1 = _cells(F.col("_lat"), F.col("_lon"), width, r_deg)
    key = lambda y, x: (y * F.lit(across) + F.pmod(x, F.lit(across))).cast("long")
    guests = F.flatten(F.transform(F.sequence(y0, y1), lambda y: F.transform(F.sequence(x0, F.least(x1, x0 + across - 1)), lambda x: key(y, x))))
    tiled = points.withColumn("_own", key(iy, ix)).withColumn("_tile", F.explode(F.when((y0 == y1) & (x0 == x1), F.array("_own")).otherwise(F.array_distinct(guests))))
    tiled = tiled.select("_id", "_lat", "_lon", "_tile", F.lit(2).alias("_side"), (F.col("_tile") == F.col("_own")).alias("_home"))
    counts = tiled.groupBy("_tile").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("_home").cast("int")).alias("homes"))
    total = counts.agg(F.sum("count"), F.sum((F.col("count") > tile_rows).cast("int"))).first()
    rows, heavy_tiles = total[0] or 0, total[1] or 0
    if not heavy_tiles:
        return tiled, rows

    # heavy tiles: halve their sides as often as needed, but no cell gets narrower than the distance asks for
    deepest = max(0, int(math.log2(width / (4 * r_deg)))) if r_deg > 0 else 20
    deepest = min(deepest, 14)
    heavy = counts.where(F.col("count") > tile_rows).select("_tile", F.least(F.lit(deepest), F.ceil(F.log2(F.col("count") / tile_rows) / 2)).cast("int").alias("_deep"), "homes")
    if heavy_tiles <= MAX_LISTED:
        heavy = F.broadcast(heavy)
    # a tile of guests alone has no pairs of its own
    marked = tiled.join(heavy, "_tile", "left").where(F.coalesce("homes", F.lit(1)) > 0).drop("homes").withColumn("_deep", F.coalesce("_deep", F.lit(0)))
    side = F.lit(width) / F.pow(F.lit(2.0), F.col("_deep"))
    parts = F.pow(F.lit(2.0), F.col("_deep")).cast("long")
    south, west = F.floor(F.col("_tile") / across) * width - 90, (F.col("_tile") % across) * width - 180
    # a guest from over the date line lies a whole turn away
    east = F.col("_lon") - west
    east = F.when(east > 180, east - 360).when(east < -180, east + 360).otherwise(east)
    grow = F.lit(r_deg * 1.001) / F.greatest(F.lit(1e-9), F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("_lat")) + r_deg))))
    clip = lambda v: F.greatest(F.lit(0), F.least(parts - 1, F.floor(v / side))).cast("long")
    north = F.col("_lat") - south
    subs = F.flatten(
        F.transform(F.sequence(clip(north - r_deg * 1.001), clip(north + r_deg * 1.001)), lambda y: F.transform(F.sequence(clip(east - grow), clip(east + grow)), lambda x: y * parts + x))
    )
    own = F.when(F.col("_home"), clip(north) * parts + clip(east)).otherwise(F.lit(-1).cast("long"))
    fine = marked.withColumns({"_ownsub": own, "_sub": F.explode(F.when(F.col("_deep") == 0, F.array(F.lit(0).cast("long"))).otherwise(subs))})
    fine = fine.withColumn("_home", F.col("_home") & ((F.col("_deep") == 0) | (F.col("_sub") == F.col("_ownsub"))))
    # what is still too many for one task is cut into chunks, and each pair of chunks is a bucket
    hot = fine.where(F.col("_deep") > 0).groupBy("_tile", "_sub").agg(F.count(F.lit(1)).alias("count"), F.max("_home").alias("_any")).where((F.col("count") > 2 * tile_rows) | ~F.col("_any"))
    hot = hot.select("_tile", "_sub", "count", F.when(F.col("_any"), F.ceil(F.col("count") / tile_rows)).otherwise(0).cast("int").alias("_chunks"))
    if radius_m is not None:
        rows += hot.agg(F.sum(F.col("count") * F.greatest(F.lit(0), F.col("_chunks") - 1))).first()[0] or 0
    hot = hot.drop("count")
    cut = fine.join(hot, ["_tile", "_sub"], "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1))).where(F.col("_chunks") > 0)
    cut = cut.withColumn("_mine", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int")).withColumn("_other", F.col("_mine") if radius_m is None else F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    side = F.when(F.col("_chunks") == 1, 2).when(F.col("_mine") == F.col("_other"), 3).when(F.col("_mine") < F.col("_other"), 0).otherwise(1)
    tile = F.xxhash64("_tile", "_sub", F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    return cut.select("_id", "_lat", "_lon", tile.alias("_tile"), side.alias("_side"), "_home"), rows


def usable_regions(regions: DataFrame, region_id: str, rings: str, area: str) -> DataFrame:
    """(_rid, _area, _rings): one row for each region with an outer ring of 3 vertices or more; vertices without both
    coordinates and holes of fewer than 3 are left out, and a null area counts as the largest."""
    whole = lambda v: v.isNotNull() & (F.size(v) >= 2) & v[0].isNotNull() & v[1].isNotNull()
    clean = F.transform(F.filter(rings, lambda r: r.isNotNull()), lambda r: F.filter(r, whole))
    there = regions.where(F.col(region_id).isNotNull() & F.col(rings).isNotNull() & (F.size(rings) > 0) & F.col(rings)[0].isNotNull()).dropDuplicates([region_id])
    slim = there.select(F.col(region_id).cast("long").alias("_rid"), F.coalesce(F.nanvl(F.col(area).cast("double"), F.lit(math.inf)), F.lit(math.inf)).alias("_area"), clean.alias("_rings"))
    return slim.where(F.size(F.col("_rings")[0]) >= 3).withColumn("_rings", F.filter("_rings", lambda r: F.size(r) >= 3))


def _as_arrays(rings: list) -> list[np.ndarray]:
    return [np.array([v[:2] for v in r], float) for r in rings]


def shared_regions(usable: DataFrame, most: int = SHARED_VERTICES) -> Regions | None:
    """All regions in order of preference (smallest area, then id), or None if they have more than ``most`` vertices."""
    n = usable.agg(F.sum(F.aggregate("_rings", F.lit(0).cast("long"), lambda s, r: s + F.size(r)))).first()[0] or 0
    if n > most:
        return None
    rows = sorted(((r["_area"], r["_rid"], _as_arrays(r["_rings"])) for r in usable.collect()), key=lambda r: r[:2])
    return Regions(np.array([r[1] for r in rows], np.int64), [r[2] for r in rows])


def within_by_boxes(points: DataFrame, usable: DataFrame, chunk_rows: int = TASK_ROWS) -> DataFrame:
    """(a_id, b_id): the preferred region of each point (_id, _lat, _lon), however many regions there are.

    A region is filed under the cells its box meets, at the grid level where these are at most four; a point asks its cell of
    every level there is. The points in a region's box then meet it in chunks of ``chunk_rows``.
    """
    spark = points.sparkSession
    cut = Cut(spark)
    outer = lambda f, k: f(F.transform(F.col("_rings")[0], lambda v: v[k]))
    boxed = cut(usable.select("_rid", "_area", "_rings", outer(F.array_min, 0).alias("x0"), outer(F.array_max, 0).alias("x1"), outer(F.array_min, 1).alias("y0"), outer(F.array_max, 1).alias("y1")), "regions")
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6))
    level = F.ceil(F.log2(extent)).cast("int")
    cell = lambda c, lv: F.floor(c / F.pow(F.lit(2.0), lv)).cast("long")
    filed = boxed.select("_rid", "x0", "x1", "y0", "y1", level.alias("lv"))
    levels = [r["lv"] for r in filed.select("lv").distinct().collect()]  # at most 30: from 1e-6 to 360 degrees
    filed = filed.withColumn("cx", F.explode(F.sequence(cell(F.col("x0"), F.col("lv")), cell(F.col("x1"), F.col("lv"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0"), F.col("lv")), cell(F.col("y1"), F.col("lv")))))
    asking = points.select("_id", "_lat", "_lon").dropDuplicates(["_id"]).withColumn("lv", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
    asking = asking.withColumns({"cx": cell(F.col("_lon"), F.col("lv")), "cy": cell(F.col("_lat"), F.col("lv"))})
    inside = reduce(lambda a, b: a & b, [F.col("_lon") >= F.col("x0"), F.col("_lon") <= F.col("x1"), F.col("_lat") >= F.col("y0"), F.col("_lat") <= F.col("y1")])
    met = cut(asking.join(filed, ["lv", "cx", "cy"]).where(inside).select("_rid", "_id", "_lat", "_lon"), "met")
    sizes = met.groupBy("_rid").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_chunks"))
    split = met.join(sizes, "_rid").select("_rid", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int").alias("_c"), "_id", "_lat", "_lon")
    shapes = boxed.join(sizes, "_rid").select("_rid", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_c"), "_area", "_rings")
    both = split.withColumns({"_area": F.lit(None).cast("double"), "_rings": F.lit(None).cast(shapes.schema["_rings"].dataType)}).unionByName(
        shapes.withColumns({"_id": F.lit(None).cast("long"), "_lat": F.lit(None).cast("double"), "_lon": F.lit(None).cast("double")}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        key = t["_rid"].to_numpy() * np.int64(1_000_003) + t["_c"].to_numpy()
        shape = t["_rings"].is_valid().to_numpy()
        ids, la, lo = (t[c].to_numpy() for c in ("_id", "_lat", "_lon"))
        pick = np.flatnonzero(~shape)
        pick = pick[np.lexsort((morton(la[pick], lo[pick]), key[pick]))]
        starts = key[pick]
        for at in np.flatnonzero(shape):
            mine = pick[np.searchsorted(starts, key[at]) : np.searchsorted(starts, key[at], "right")]
            mine = mine[t["_rid"].to_numpy()[mine] == t["_rid"][int(at)].as_py()]
            if len(mine):
                one = Regions(np.array([0]), [_as_arrays(t["_rings"][int(at)].as_py())])
                hit = mine[one.first(lo[mine], la[mine]) >= 0].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit].astype(np.int64)), pa.array(np.full(len(hit), t["_area"][int(at)].as_py())), pa.array(np.full(len(hit), t["_rid"][int(at)].as_py(), np.int64))], ["b_id", "area", "a_id"])

    held = both.repartition(tasks_for(spark, met.count(), chunk_rows), "_rid", "_c").mapInArrow(run, "b_id long, area double, a_id long")
    return held.groupBy("b_id").agg(F.min(F.struct("area", "a_id"))["a_id"].alias("a_id")).select("a_id", "b_id")


_SCHEMA = pa.schema([("_kind", pa.int8()), ("a_id", pa.int64()), ("b_id", pa.int64())])


def _batches(kind: int, a: np.ndarray, b: np.ndarray, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(a), rows):
        x, y = a[s : s + rows], b[s : s + rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), pa.array(x.astype(np.int64, copy=False)), pa.array(y.astype(np.int64, copy=False))], schema=_SCHEMA)


def dual_tree_join(
    points: DataFrame,
    radius_m: float | None = 50.0,
    regions: DataFrame | None = None,
    *,
    point_id: str = "pt_id",
    lat: str = "lat",
    lon: str = "lon",
    region_id: str = "objectid",
    rings: str = "coordinates",
    area: str = "shape_area",
    tile_deg: float = TILE_DEG,
    tile_rows: int = TILE_ROWS,
    shared_vertices: int = SHARED_VERTICES,
) -> DataFrame:
    """``kind, a_id, b_id``: ``near`` pairs a_id < b_id of points at most ``radius_m`` apart on the sphere, and ``within`` rows
    with the preferred region (smallest area, then id) a_id that contains the point b_id.

    Rows with a null or NaN id or coordinate, or a latitude outside -90..90, take no part. Rows repeated under one id count
    once, at the same place. Regions without geometry, or with an outer ring of fewer than 3 vertices, contain nothing; a null
    area counts as the largest. Empty tables give an empty result; further columns are ignored. Regions are sent to the tasks
    if they have ``shared_vertices`` or fewer in all (16 bytes each), else joined by their boxes.
    """
    spark = points.sparkSession
    slim = points.select(F.col(point_id).cast("long").alias("_id"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    slim = slim.where(F.col("_id").isNotNull() & F.col("_lat").between(-90, 90) & F.col("_lon").between(-540, 540))
    slim = slim.withColumn("_lon", F.when(F.col("_lon").between(-180, 180), F.col("_lon")).otherwise(F.pmod(F.col("_lon") + 180, F.lit(360.0)) - 180))
    usable = None if regions is None else usable_regions(regions, region_id, rings, area)
    small = None if usable is None else shared_regions(usable, shared_vertices)
    tiled, rows = _tiled(slim, radius_m, tile_deg, tile_rows)
    n = tasks_for(spark, rows, TASK_ROWS)
    placed = tiled.select("_id", "_lat", "_lon", F.when(F.col("_home"), F.lit(1)).otherwise(F.lit(0)).cast("byte").alias("_home"), "_tile", F.col("_side").cast("byte").alias("_side")).repartition(n, "_tile")
    shared = spark.sparkContext.broadcast(small) if small is not None else None
    near = radius_m is not None

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        cols = [table.column(c).to_numpy() for c in ("_id", "_lat", "_lon", "_home", "_tile", "_side")]
        side, tile = cols[5], cols[4]
        # whole tiles share one tree; each chunk has its own, and each pair of chunks two
        for at in [np.flatnonzero(side == 2), *(np.flatnonzero(tile == k) for k in np.unique(tile[side != 2]))]:
            if len(at):
                yield from one_bucket(*(c[at] for c in cols))

    def one_bucket(ids, la, lo, home, tile, side) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((-home, ids))  # of rows of one id, the one at home stays
        ids, la, lo, home, side = (c[order] for c in (ids, la, lo, home, side))
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, la, lo, home, side = (c[first] for c in (ids, la, lo, home, side))
        order = np.argsort(morton(la, lo), kind="stable")
        ids, la, lo, home, side = ids[order], la[order], lo[order], home[order].astype(bool), side[order]
        if near:
            # of guests alone no pair is asked for
            parts = [(np.flatnonzero(there & home), np.flatnonzero(there & ~home)) for there in ([side >= 2] if side[0] >= 2 else [side == 0, side == 1])]
            (h0, g0), (h1, g1) = parts[0], parts[-1]
            joins = [(h0, None, False), (h0, g0, True)] if len(parts) == 1 else [(h0, h1, False), (h0, g1, True), (h1, g0, True)]
            trees: dict[int, BoxTree] = {}
            for p, q, guests in joins:
                if not len(p) or (q is not None and not len(q)):
                    continue
                one, two = (None if x is None else trees.setdefault(id(x), BoxTree(la[x], lo[x])) for x in (p, q))
                for a, b in near_pairs(one, two, radius_m):
                    a, b = ids[p[a]], ids[p[b] if q is None else q[b]]
                    if guests:  # such a pair comes from the home of its smaller id
                        a, b = a[a < b], b[a < b]
                    yield from _batches(0, np.minimum(a, b), np.maximum(a, b))
        if shared is not None and side[0] >= 2:
            held = shared.value
            own = ids[home]
            found = held.first(lo[home], la[home])
            hit = found >= 0
            yield from _batches(1, held.ids[found[hit]], own[hit])

    out = None
    if near or shared is not None:
        kind = F.when(F.col("_kind") == 0, "near").otherwise("within").alias("kind")
        out = placed.mapInArrow(join, "_kind byte, a_id long, b_id long").select(kind, "a_id", "b_id")
    if usable is not None and small is None:
        within = within_by_boxes(slim, usable).select(F.lit("within").alias("kind"), "a_id", "b_id")
        out = within if out is None else out.unionByName(within)
    return out if out is not None else spark.createDataFrame([], "kind string, a_id long, b_id long")
