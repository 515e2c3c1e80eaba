"""Neighbour joins: k nearest, within a radius, in a subset; and what is counted from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marchland.operators import tree_knn
from marchland.session import Cut, parallelism, tasks_for


def vector(df: DataFrame, dims: list[str] | str) -> Column:
    """The point as an array of doubles, from its columns or from one array column; -0.0 becomes 0.0."""
    if isinstance(dims, str):
        return F.transform(F.col(dims), lambda v: v.cast("double") + F.lit(0.0))
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in dims])


def _clean(df: DataFrame, uid: str, dims: list[str] | str) -> DataFrame:
    slim = df.select(F.col(uid).cast("long").alias("_u"), vector(df, dims).alias("_v"))
    return slim.where(F.col("_u").isNotNull() & F.col("_v").isNotNull() & ~F.exists("_v", lambda v: v.isNull() | F.isnan(v)))


def _width(df: DataFrame, dims: list[str] | str) -> int:
    if not isinstance(dims, str):
        return len(dims)
    row = df.select(F.size(dims).alias("n")).where(F.col(dims).isNotNull()).first()
    return row["n"] if row else 1


def _edges(lists: DataFrame, k: int) -> DataFrame:
    flat = lists.select("_u", F.posexplode("_near").alias("pos", "e")).where(F.col("pos") < k)
    return flat.select(F.col("_u").alias("id"), (F.col("pos") + 1).alias("rank"), F.col("e.i").alias("nbr"), F.col("e.d").alias("d2"))


def knn(df: DataFrame, k: int, uid: str = "id", dims: list[str] | str = ("x", "y"), leaf_rows: int = tree_knn.LEAF_ROWS, approximate: bool = False) -> DataFrame:
    """(id, rank, nbr, d2): the k nearest other points of each point, ordered by squared distance, then id. Exact.

    Points at one place are each other's neighbours at distance 0. Rows with a null id or component, or a NaN one, take no
    part; rows repeated under one id count once. With k or fewer points each has all others. Equal points are searched for
    once, and of very many copies only the lowest ids can be neighbours, so hot places don't matter. ``approximate`` looks
    into each point's own leaf of about ``leaf_rows`` points only (see ``recall``).
    """
    dims = dims if isinstance(dims, str) else list(dims)
    d = _width(df, dims)
    cut = Cut(df.sparkSession)
    slim = _clean(df, uid, dims)
    distinct = cut(tree_knn.distinct_vectors(slim, F.lit(0), F.col("_u"), F.col("_v"), k + 2), "distinct")
    lists = tree_knn.nearest_lists(distinct, tree_knn.Space(d), k, leaf_rows, others=not approximate)
    several = distinct.where(F.size("_heads") > 1).select("_u", F.slice("_heads", 1, k + 1).alias("_heads"))
    each = lists.select("_u", "_near").join(several, "_u", "left").select(F.explode(F.coalesce("_heads", F.array("_u"))).alias("_u"), "_near")
    each = each.withColumn("_near", F.filter("_near", lambda e: e["i"] != F.col("_u")))
    hot = distinct.where(F.size("_heads") == k + 2).select("_v", F.slice("_heads", 1, k).alias("_low"), F.element_at("_heads", k + 1).alias("_last"))
    tails = slim.join(hot, "_v").where(F.col("_u") > F.col("_last")).groupBy("_u").agg(F.first("_low").alias("_low"))
    tails = tails.select("_u", F.transform("_low", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("i"))).alias("_near"))
    return _edges(each.unionByName(tails), k)


def _prepared(v: Column, metric: str, variances: list[float] | None) -> Column:
    """Vectors whose Euclidean distance orders like the metric: unit, centred unit, centred unit ranks, or scaled."""

    def total(a: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
        return F.aggregate(F.transform(a, f), F.lit(0.0), lambda s, x: s + x)

    if metric == "seuclidean":
        return F.zip_with(v, F.array(*[F.lit(float(x) ** 0.5) for x in variances or []]), lambda a, w: a / w)
    if metric == "spearman":
        v = F.transform(v, lambda x: F.size(F.filter(v, lambda y: y < x)) + (F.size(F.filter(v, lambda y: y == x)) + 1) / 2.0)
    if metric in ("correlation", "spearman"):
        v = F.zip_with(v, F.array_repeat(total(v) / F.size(v), F.size(v)), lambda x, m: x - m)
    norm = F.sqrt(total(v, lambda x: x * x))
    return F.when(norm > 0, F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n))


#: Metrics of blocks of rows: (rows, 1, d) against (1, rows, d).
_BLOCK = {
    "squared_euclidean": lambda a, b, p: ((a - b) ** 2).sum(axis=2),
    "euclidean": lambda a, b, p: np.sqrt(((a - b) ** 2).sum(axis=2)),
    "cityblock": lambda a, b, p: np.abs(a - b).sum(axis=2),
    "chebychev": lambda a, b, p: np.abs(a - b).max(axis=2),
    "minkowski": lambda a, b, p: (np.abs(a - b) ** p).sum(axis=2) ** (1 / p),
    "hamming": lambda a, b, p: (a != b).mean(axis=2),
    "jaccard": lambda a, b, p: ((a != b) & ((a != 0) | (b != 0))).sum(axis=2) / np.maximum(1, ((a != 0) | (b != 0)).sum(axis=2)),
}


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``recall``: the share of the exact neighbour pairs that were found."""
    hit = exact.select("id", "nbr").join(found.select("id", "nbr").withColumn("_hit", F.lit(1)), ["id", "nbr"], "left")
    return hit.agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def tuned_leaf_rows(df: DataFrame, k: int, precision: float, uid: str = "id", dims: list[str] | str = ("x", "y"), share: float = 0.01, steps: tuple[int, ...] = (64, 256, 1024, 4096, 16_384)) -> int:
    """The smallest leaf with which the approximate search finds ``precision`` of the true neighbours of a sample of points.

    The sample is ``share`` of the points by hash of their id, at least those needed to have one; its true neighbours are
    searched for once.
    """
    dims = dims if isinstance(dims, str) else list(dims)
    hashed = F.xxhash64(F.lit(13), F.col(uid)).cast("double") / F.lit(2.0**64) + 0.5
    probe = df.where(hashed < share)
    if probe.limit(1).count() == 0:
        probe = df
    exact = Cut(df.sparkSession)(nearest_in(probe, df, k, uid, dims), "exact")
    for rows in steps[:-1]:
        got = knn(df, k, uid, dims, rows, approximate=True).join(exact.select("id").distinct(), "id", "left_semi")
        if (recall(got, exact).first()["recall"] or 0.0) >= precision:
            return rows
    return steps[-1]


def knn_metric(df: DataFrame, k: int, metric: str, uid: str = "id", dims: list[str] | str = ("x", "y"), p: float = 3.0, variances: list[float] | None = None, block_rows: int = 4096) -> DataFrame:
    """(id, rank, nbr, dist): the k nearest by a named metric, by (dist, id).

    cosine, correlation, spearman and seuclidean become Euclidean on prepared vectors, so the tree search prunes them;
    vectors without direction take no part. For the others blocks of rows meet block by block, each task keeping the k best of
    its block for each row: the work is quadratic, so use them for small tables. Rows repeated under one id count once.
    """
    dims = dims if isinstance(dims, str) else list(dims)
    cut = Cut(df.sparkSession)
    if metric in ("cosine", "correlation", "spearman", "seuclidean"):
        ready = cut(_clean(df, uid, dims).select(F.col("_u").alias("id"), _prepared(F.col("_v"), metric, variances).alias("v")).where(F.col("v").isNotNull()), "prepared")
        near = knn(ready, k, dims="v")
        return near.select("id", "rank", "nbr", (F.sqrt("d2") if metric == "seuclidean" else F.col("d2") / 2).alias("dist"))
    measure, d = _BLOCK[metric], _width(df, dims)
    slim = cut(_clean(df, uid, dims).dropDuplicates(["_u"]), "points")
    n = slim.count()
    blocks = max(1, -(-n // block_rows))
    block, every = F.pmod(F.xxhash64("_u"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = slim.select("_u", "_v", block.alias("r"), every.alias("c"), F.lit(True).alias("asks"))
    s = slim.select("_u", "_v", every.alias("r"), block.alias("c"), F.lit(False).alias("asks"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(b.num_rows for b in parts):
            return
        t = pa.Table.from_batches(parts).sort_by([("r", "ascending"), ("c", "ascending"), ("_u", "ascending")])
        r, c, uid_, asks, x = t["r"].to_numpy(), t["c"].to_numpy(), t["_u"].to_numpy(), t["asks"].to_numpy(), tree_knn.vectors(t["_v"], d)
        for lo, hi in tree_knn.runs(r, c):
            ask, data = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(~asks[lo:hi])
            step = max(1, (1 << 21) // max(1, len(data) * d))
            for o in range(0, len(ask), step):
                at = ask[o : o + step]
                dist = measure(x[at][:, None], x[data][None], p).astype(float)
                dist[uid_[at][:, None] == uid_[data]] = np.inf
                limit = np.partition(dist, min(k, len(data)) - 1, axis=1)[:, min(k, len(data)) - 1] if len(data) else np.zeros(len(at))
                i, j = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
                order = np.lexsort((uid_[data[j]], dist[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(uid_[at[i]]), pa.array(uid_[data[j]]), pa.array(dist[i, j])], ["id", "nbr", "dist"])

    found = q.unionByName(s).repartition(tasks_for(df.sparkSession, blocks * blocks, 1), "r", "c").mapInArrow(meet, "id long, nbr long, dist double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "nbr"))).where(F.col("rank") <= k).select("id", "rank", "nbr", "dist")


def knn_grid(df: DataFrame, k: int, uid: str = "id", x: str = "x", y: str = "y", levels: int = 10) -> DataFrame:
    """(id, rank, nbr, d2) of points in the plane by grid cells that fit the density, all in built-in operators.

    Cells come in ``levels`` sizes, each half of the one before. A point looks into the nine cells around it at the finest level
    where its own still holds k points or more, and is settled if its k-th distance lies within them; the others, and those in
    cells too crowded at the finest level of all, go through the tree search. Same result as ``knn``.
    """
    cut = Cut(df.sparkSession)
    slim = df.select(F.col(uid).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    slim = cut(slim.where(F.col("id").isNotNull() & ~F.isnan(F.coalesce("x", F.lit(float("nan")))) & ~F.isnan(F.coalesce("y", F.lit(float("nan"))))).dropDuplicates(["id"]), "points")
    box = slim.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not box["n"]:
        return slim.select("id", F.lit(1).alias("rank"), F.col("id").alias("nbr"), F.lit(0.0).alias("d2"))
    area = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"]) or max(box["x1"] - box["x0"], box["y1"] - box["y0"]) ** 2 or 1.0
    top = 8 * max((area * k / box["n"]) ** 0.5, 1e-9)
    side = F.lit(top) / F.pow(F.lit(2.0), F.col("lv"))
    cell = lambda c, lo: F.floor((F.col(c) - F.lit(lo)) / side)
    placed = slim.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumns({"cx": cell("x", box["x0"]), "cy": cell("y", box["y0"])})
    crowd = placed.groupBy("lv", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    # the finest level with k points in the cell, unless that is the last one and the cell is far fuller
    mine = placed.join(crowd, ["lv", "cx", "cy"]).groupBy("id", "x", "y").agg(F.max(F.struct("lv", "n", "cx", "cy")).alias("m"))
    asks = mine.select("id", "x", "y", "m.*").where((F.col("lv") < levels - 1) | (F.col("n") <= 8 * k))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    probe = asks.withColumn("o", F.explode(steps)).select("id", "x", "y", "lv", F.col("cx").alias("ox"), F.col("cy").alias("oy"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    # of a cell's points only those at levels that are asked for are met; a far fuller cell beside a thin one leaves its asker open
    full = placed.groupBy("lv", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 32 * k).select("lv", "cx", "cy", F.lit(True).alias("full"))
    marked = probe.join(full, ["lv", "cx", "cy"], "left")
    stuck = marked.where("full").select("id").distinct()
    stock = placed.select(F.col("id").alias("nbr"), F.col("x").alias("bx"), F.col("y").alias("by"), "lv", "cx", "cy")
    pairs = probe.join(stuck, "id", "left_anti").join(stock, ["lv", "cx", "cy"]).where(F.col("id") != F.col("nbr"))
    pairs = pairs.withColumn("d2", (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")))
    # the k-th distance must lie within the nine cells
    left, low = F.col("x") - (F.lit(box["x0"]) + (F.col("ox") - 1) * side), F.col("y") - (F.lit(box["y0"]) + (F.col("oy") - 1) * side)
    edge = F.least(left, 3 * side - left, low, 3 * side - low)
    near = pairs.where(F.sqrt("d2") < edge * (1 - 1e-9)).select("id", "nbr", "d2")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "nbr"))).where(F.col("rank") <= k)
    done = cut(ranked.withColumn("found", F.max("rank").over(Window.partitionBy("id"))).where(F.col("found") == k).select("id", "rank", "nbr", "d2"), "settled")
    open_ = slim.join(done.where("rank = 1").select("id"), "id", "left_anti")
    return done.unionByName(nearest_in(open_, slim, k, dims=["x", "y"]))


def nearest_in(queries: DataFrame, base: DataFrame, k: int = 1, uid: str = "id", dims: list[str] | str = ("x", "y"), leaf_rows: int = tree_knn.LEAF_ROWS) -> DataFrame:
    """(id, rank, nbr, d2): the k nearest points of ``base`` for each query; the same id in both is no neighbour of itself."""
    dims = dims if isinstance(dims, str) else list(dims)
    d = _width(queries, dims)
    lists = tree_knn.nearest_in(_clean(queries, uid, dims).dropDuplicates(["_u"]), _clean(base, uid, dims).dropDuplicates(["_u"]), d, k, leaf_rows)
    return _edges(lists, k)


#: Lists that the ids of one place are dealt out to, by hash.
PLACE_LISTS = 64
#: Rows of one cell that one task asks for.
CELL_ASKS = 16_384


def _places(df: DataFrame, uid: str, x: str, y: str) -> DataFrame:
    """(x, y, ids, salt): the ids of each place, in lists short enough even for a hot one. Rows without id or place have no pairs."""
    rows = df.select(F.col(uid).alias("u"), F.col(x).alias("x"), F.col(y).alias("y")).where(F.col("u").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    return rows.groupBy("x", "y", F.pmod(F.xxhash64("u"), F.lit(PLACE_LISTS)).alias("salt")).agg(F.collect_list("u").alias("ids"))


def radius_pairs(queries: DataFrame, base: DataFrame, radius: float, uid: str = "id", x: str = "x", y: str = "y", strict: bool = False) -> DataFrame:
    """(id, nbr, d2) within the radius (``strict``: nearer than it), by an equi-join on cells of the radius' size.

    Places are compared, not rows: lists of ids meet and are written out as pairs where their places are near. The askers of
    a crowded cell are shared out over parts, each of which gets the cell's rows. Both sides are shuffled whatever the
    planner takes their size for: as a broadcast, the rows of one side would have to fit the driver.
    """
    side = radius if radius > 0 else 1.0
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = _places(queries, uid, x, y).withColumn("o", F.explode(steps))
    q = q.select("x", "y", "ids", "salt", (F.floor(F.col("x") / side) + F.col("o.i")).alias("cx"), (F.floor(F.col("y") / side) + F.col("o.j")).alias("cy"))
    b = _places(base, uid, x, y).select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("ids").alias("nbrs"), F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    # at most 9 rows / CELL_ASKS cells
    crowded = q.groupBy("cx", "cy").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > CELL_ASKS)
    crowded = F.broadcast(crowded.select("cx", "cy", F.least(F.lit(PLACE_LISTS), F.ceil(F.col("n") / CELL_ASKS)).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    q = q.join(crowded, ["cx", "cy"], "left").withColumn("part", F.pmod(F.col("salt"), parts))
    b = b.join(crowded, ["cx", "cy"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    # a fixed number of tasks: by the bytes that they read, a few would write all pairs
    tasks, at = parallelism(queries.sparkSession), ["cx", "cy", "part"]
    q, b = q.select(*at, "x", "y", "ids").repartition(tasks, *at), b.select(*at, "bx", "by", "nbrs").repartition(tasks, *at)
    d2 = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
    limit = F.lit(float(radius)) * F.lit(float(radius))
    near = q.join(b.hint("merge"), at).select("ids", "nbrs", d2.alias("d2")).where(F.col("d2") < limit if strict else F.col("d2") <= limit)
    pairs = near.select(F.explode("ids").alias("id"), "nbrs", "d2").select("id", F.explode("nbrs").alias("nbr"), "d2")
    return pairs.where(F.col("id") != F.col("nbr"))


def radius_count(points: DataFrame, radius: float, uid: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(id, n): other points within the radius, 0 included."""
    counts = radius_pairs(points, points, radius, uid, x, y).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return points.select(F.col(uid).alias("id")).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def radius_capped(points: DataFrame, radius: float, most: int, uid: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(id, rank, nbr, d2): the nearest ``most`` points within the radius."""
    best = Window.partitionBy("id").orderBy("d2", "nbr")
    return radius_pairs(points, points, radius, uid, x, y).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("id", "rank", "nbr", "d2")


def reverse_count(edges: DataFrame, points: DataFrame, uid: str = "id") -> DataFrame:
    """(id, n): how many points have this one among their neighbours."""
    counts = edges.groupBy(F.col("nbr").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return points.select(F.col(uid).alias("id")).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def influence_space(edges: DataFrame) -> DataFrame:
    """(id, nbr): neighbours and reverse neighbours of each point."""
    return edges.select("id", "nbr").unionByName(edges.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct()


def shared_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, shared, weight), src < dst: pairs with shared neighbours, oneself counted as one's own; weight is the share of
    the union of the two lists. A list has k + 1 entries, so only popular neighbours make long groups: those are split by
    the join's skew handling."""
    own = edges.select("id", "nbr").unionByName(edges.select("id", F.col("id").alias("nbr")).distinct())
    a, b = own.select(F.col("id").alias("src"), "nbr"), own.select(F.col("id").alias("dst"), "nbr")
    pairs = a.join(b, "nbr").where(F.col("src") < F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.withColumn("weight", F.col("shared") / (2 * (k + 1) - F.col("shared")))


def lsh_candidates(df: DataFrame, masks: list[list[int]], probe_bits: int = 0, uid: str = "id", words: str = "words") -> DataFrame:
    """(id, nbr): pairs of bit vectors that share a masked key in a table; with ``probe_bits`` 1, keys that differ in one of the
    mask's bits are probed too. ``masks`` holds for each table a mask for each word."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.concat_ws("-", *[F.element_at(words, i + 1).bitwiseAND(F.lit(m)).cast("string") for i, m in enumerate(mask)]).alias("key")) for t, mask in enumerate(masks)])
    stock = df.select(F.col(uid).alias("nbr"), F.explode(tables).alias("e")).select("nbr", "e.t", "e.key")
    probes = []
    for t, mask in enumerate(masks):
        flips = [[0] * len(mask)]
        if probe_bits:
            flips += [[1 << b if j == i else 0 for j in range(len(mask))] for i, m in enumerate(mask) for b in range(m.bit_length()) if m >> b & 1]
        for f in flips:
            key = F.concat_ws("-", *[F.element_at(words, i + 1).bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(f[i])).cast("string") for i, m in enumerate(mask)])
            probes.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    asks = df.select(F.col(uid).alias("id"), F.explode(F.array(*probes)).alias("e")).select("id", "e.t", "e.key")
    return asks.join(stock, ["t", "key"]).where(F.col("id") != F.col("nbr")).select("id", "nbr").distinct()


def hamming_knn(df: DataFrame, k: int, masks: list[list[int]] | None = None, uid: str = "id", words: str = "words") -> DataFrame:
    """(id, rank, nbr, dist): nearest bit vectors by Hamming distance; exact, or among LSH candidates if masks are given."""
    from marchland.functions.distances import hamming_bits

    if masks is None:
        return knn_hamming_exact(df, k, uid, words)
    base = df.select(F.col(uid).alias("id"), F.col(words).alias("w"))
    pairs = lsh_candidates(df, masks, 1, uid, words).join(base.withColumnRenamed("w", "a"), "id").join(base.select(F.col("id").alias("nbr"), F.col("w").alias("b")), "nbr")
    best = Window.partitionBy("id").orderBy("dist", "nbr")
    return pairs.withColumn("dist", hamming_bits(F.col("a"), F.col("b"))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "nbr", "dist")


def knn_hamming_exact(df: DataFrame, k: int, uid: str = "id", words: str = "words", block_rows: int = 4096) -> DataFrame:
    """Blocks of rows meet block by block; bits are counted in built-in expressions."""
    from marchland.functions.distances import hamming_bits

    cut = Cut(df.sparkSession)
    slim = cut(df.select(F.col(uid).alias("id"), F.col(words).alias("w")).dropDuplicates(["id"]), "words")
    blocks = max(1, -(-slim.count() // block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q, s = slim.select("id", F.col("w").alias("a"), block.alias("r"), every.alias("c")), slim.select(F.col("id").alias("nbr"), F.col("w").alias("b"), block.alias("c"), every.alias("r"))
    best = Window.partitionBy("id").orderBy("dist", "nbr")
    pairs = q.join(s, ["r", "c"]).where(F.col("id") != F.col("nbr")).select("id", "nbr", hamming_bits(F.col("a"), F.col("b")).alias("dist"))
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "nbr", "dist")


class _Rotated(tree_knn.Space):
    """The vectors in randomly turned axes: distances stay the same, the tree's splits don't."""

    def __init__(self, d: int, seed: int) -> None:
        super().__init__(d)
        self.axes = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]

    def place(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes


def knn_forest(df: DataFrame, k: int, uid: str = "id", dims: list[str] | str = ("x", "y"), trees: int = 4, leaf_rows: int = 1024) -> DataFrame:
    """(id, rank, nbr, d2), approximate: the k nearest of what each point's own leaves of several randomly turned trees hold.

    Rows as in ``knn``, but a place of many points lists its lowest ids only. More trees or larger leaves find more (``recall``).
    """
    dims = dims if isinstance(dims, str) else list(dims)
    d = _width(df, dims)
    cut = Cut(df.sparkSession)
    points = cut(_clean(df, uid, dims).dropDuplicates(["_u"]), "points")
    distinct = cut(tree_knn.distinct_vectors(points, F.lit(0), F.col("_u"), F.col("_v"), k + 2), "distinct")
    lists = None
    for t in range(trees):
        one = tree_knn.nearest_lists(distinct, tree_knn.Space(d) if t == 0 else _Rotated(d, t), k, leaf_rows, others=False)
        lists = one if lists is None else lists.unionByName(one)
    merged = lists.groupBy("_u").agg(F.array_distinct(F.flatten(F.collect_list("_near"))).alias("_near"))
    # a distance found in turned axes may differ in its last digits
    flat = merged.select("_u", F.explode("_near").alias("e")).groupBy("_u", F.col("e.i").alias("i")).agg(F.min("e.d").alias("d"))
    several = distinct.select("_u", F.explode("_heads").alias("id"))
    each = several.join(flat, "_u").where(F.col("id") != F.col("i"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "i"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", F.col("i").alias("nbr"), F.col("d").alias("d2"))


def knn_descent(df: DataFrame, start: DataFrame, k: int, uid: str = "id", dims: list[str] | str = ("x", "y"), rounds: int = 2) -> DataFrame:
    """(id, rank, nbr, d2), approximate: neighbour lists bettered by the neighbours' neighbours, some rounds over.

    ``start`` (id, rank, nbr, d2) may be any lists, as those of ``knn_forest``. A round looks at k + k² candidates a point.
    """
    dims = dims if isinstance(dims, str) else list(dims)
    cut = Cut(df.sparkSession)
    points = cut(_clean(df, uid, dims).dropDuplicates(["_u"]), "points")
    a, b = points.select(F.col("_u").alias("id"), F.col("_v").alias("va")), points.select(F.col("_u").alias("nbr"), F.col("_v").alias("vb"))
    now = start.select("id", "nbr", "d2")
    d2 = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "nbr"))
    for turn in range(rounds):
        second = now.select("id", F.col("nbr").alias("m")).join(now.select(F.col("id").alias("m"), "nbr"), "m").select("id", "nbr")
        new = second.where(F.col("id") != F.col("nbr")).distinct().join(now.select("id", "nbr"), ["id", "nbr"], "left_anti")
        scored = new.join(b, "nbr").join(a, "id").select("id", "nbr", d2.alias("d2"))
        now = cut(now.unionByName(scored).withColumn("rank", rank).where(F.col("rank") <= k).select("id", "nbr", "d2"), f"round{turn}")
    return now.withColumn("rank", rank).select("id", "rank", "nbr", "d2")
