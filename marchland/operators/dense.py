"""Links and degrees of points in the plane within a distance, without listing pairs: cells whose diagonal is the distance hold
points that are all linked, pairs of cells are decided by their boxes where they can be, and crowded buckets are cut into
chunks that meet pair by pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marchland.operators.components import forest
from marchland.session import Cut, tasks_for

TASK_ROWS = 60_000
HOT_BUCKET = 8_192
GRID = 8
PAIRS = 1 << 18


def rounded(v: np.ndarray, digits: int | None) -> np.ndarray:
    return v if digits is None else np.round(v, digits)


def cell_links(bucket: np.ndarray, x: np.ndarray, y: np.ndarray, eps: float, limit: float, digits: int | None = 6) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of one link for each pair of touching cells, and of each point to its cell's first point.

    The cells' diagonal is the distance, so the points of a cell are all linked.
    """
    side = eps / math.sqrt(2) * (1 - 1e-9)
    cx, cy = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
    cx, cy = cx - cx.min() + 2, cy - cy.min() + 2
    height, width = int(cy.max()) + 3, int(cx.max()) + 3
    key = (bucket * width + cx) * height + cy
    order = np.argsort(key, kind="stable")
    key = key[order]
    cell, start, count = np.unique(key, return_index=True, return_counts=True)
    first = np.repeat(start, count)
    out_a, out_b = [order[first]], [order]
    px, py = x[order], y[order]
    near = sorted(((i, j) for i in range(0, 3) for j in range(-2, 3) if i > 0 or j > 0), key=lambda o: o[0] ** 2 + o[1] ** 2)
    for dx, dy in near:
        at = np.searchsorted(cell, cell + dx * height + dy)
        ok = (at < len(cell)) & (cell[np.minimum(at, len(cell) - 1)] == cell + dx * height + dy)
        a, b = np.flatnonzero(ok), at[ok]
        if not len(a):
            continue
        # a few points of each cell decide most pairs; the others are looked through
        done = np.zeros(len(a), bool)
        for i in range(3):
            for j in range(3):
                p, q = start[a] + i * (count[a] - 1) // 2, start[b] + j * (count[b] - 1) // 2
                hit = ~done & (rounded((px[p] - px[q]) ** 2 + (py[p] - py[q]) ** 2, digits) <= limit)
                out_a.append(order[p[hit]]), out_b.append(order[q[hit]])
                done |= hit
        a, b = a[~done], b[~done]
        sizes = count[a] * count[b]
        group = np.cumsum(sizes) // PAIRS
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(group)) + 1) if len(a) else []:
            k = np.repeat(part, sizes[part])
            o = np.arange(len(k)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
            p, q = start[a[k]] + o // count[b[k]], start[b[k]] + o % count[b[k]]
            hit = np.flatnonzero(rounded((px[p] - px[q]) ** 2 + (py[p] - py[q]) ** 2, digits) <= limit)
            _, one = np.unique(k[hit], return_index=True)
            out_a.append(order[p[hit[one]]]), out_b.append(order[q[hit[one]]])
    return np.concatenate(out_a), np.concatenate(out_b)


def disc_counts(bucket: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, eps: float, limit: float, digits: int | None = 6) -> np.ndarray:
    """For each point, the sum of n over the points of its bucket within the distance, itself included.

    The points of a cell whose diagonal is the distance are all linked. Of two near cells the boxes decide where they can;
    large undecided ranges are halved along the order within the cell, small ones compared point by point.
    """
    side = eps / math.sqrt(2) * (1 - 1e-9)
    fx, fy = x / side, y / side
    cx, cy = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
    ux, uy = ((fx - cx) * 256).astype(np.int64), ((fy - cy) * 256).astype(np.int64)
    fine = sum(((ux >> k & 1) << (2 * k + 1)) | ((uy >> k & 1) << (2 * k)) for k in range(8))
    cx, cy = cx - cx.min() + 2, cy - cy.min() + 2
    height, width = int(cy.max()) + 3, int(cx.max()) + 3
    key = (bucket * width + cx) * height + cy
    order = np.lexsort((fine, key))
    key, px, py, w = key[order], x[order], y[order], n[order]
    cell, start, count = np.unique(key, return_index=True, return_counts=True)
    ends = np.append(0, np.cumsum(w))
    total = np.zeros(len(w) + 1, np.int64)  # differences, of what holds for whole ranges
    deg = np.zeros(len(w), np.int64)

    def whole(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        v = ends[b1] - ends[b0]
        np.add.at(total, a0, v)
        np.add.at(total, a1, -v)

    def boxes(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
        both, back = np.unique(np.stack([s, e], axis=1), axis=0, return_inverse=True)
        at = both.ravel()
        return tuple(f.reduceat(np.append(c, c[-1:]), at)[::2][back.ravel()] for c in (px, py) for f in (np.minimum, np.maximum))

    whole(start, start + count, start, start + count)
    for dx, dy in ((i, j) for i in range(-2, 3) for j in range(-2, 3) if i or j):
        at = np.searchsorted(cell, cell + dx * height + dy)
        a = np.flatnonzero((at < len(cell)) & (cell[np.minimum(at, len(cell) - 1)] == cell + dx * height + dy))
        a0, a1, b0, b1 = start[a], start[a] + count[a], start[at[a]], start[at[a]] + count[at[a]]
        while len(a0):
            ax0, ax1, ay0, ay1 = boxes(a0, a1)
            bx0, bx1, by0, by1 = boxes(b0, b1)
            far = np.maximum(ax1 - bx0, bx1 - ax0) ** 2 + np.maximum(ay1 - by0, by1 - ay0) ** 2
            near = np.maximum(0, np.maximum(ax0 - bx1, bx0 - ax1)) ** 2 + np.maximum(0, np.maximum(ay0 - by1, by0 - ay1)) ** 2
            inside = rounded(far, digits) <= limit
            whole(a0[inside], a1[inside], b0[inside], b1[inside])
            open_ = ~inside & (rounded(near, digits) <= limit)
            a0, a1, b0, b1 = a0[open_], a1[open_], b0[open_], b1[open_]
            few = (a1 - a0) * (b1 - b0) <= 1024
            s, z, t, c = a0[few], (a1 - a0)[few], b0[few], (b1 - b0)[few]
            sizes = z * c
            for part in np.split(np.arange(len(s)), np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1) if len(s) else []:
                k = np.repeat(part, sizes[part])
                o = np.arange(len(k)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
                p, q = s[k] + o // c[k], t[k] + o % c[k]
                hit = rounded((px[p] - px[q]) ** 2 + (py[p] - py[q]) ** 2, digits) <= limit
                np.add.at(deg, p[hit], w[q[hit]])
            a0, a1, b0, b1 = a0[~few], a1[~few], b0[~few], b1[~few]
            left = (a1 - a0) >= (b1 - b0)  # the longer range is halved
            am, bm = np.where(left, (a0 + a1) // 2, a1), np.where(left, b1, (b0 + b1) // 2)
            a0, a1, b0, b1 = np.append(a0, np.where(left, am, a0)), np.append(am, a1), np.append(b0, np.where(left, b0, bm)), np.append(bm, b1)
    out = np.empty(len(w), np.int64)
    out[order] = deg + np.cumsum(total[:-1])
    return out


def split_hot(rows: DataFrame, hot_bucket: int) -> DataFrame:
    """``rows`` (k, _u, ...) with a side: a bucket k of too many rows is cut into chunks, and each pair of chunks is a bucket.
    Rows of side 2 meet all of their bucket, those of sides 0 and 1 the other side."""
    hot = rows.groupBy("k").count().where(F.col("count") > hot_bucket).select("k", F.ceil(F.col("count") / hot_bucket).cast("int").alias("s"))
    if (n_hot := hot.count()) == 0:
        return rows.withColumn("side", F.lit(2))
    if n_hot <= 100_000:
        hot = F.broadcast(hot)
    mixed = rows.join(hot, "k", "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("_u"), F.col("s"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    low, high = F.least("c", F.col("o").cast("long")), F.greatest("c", F.col("o").cast("long"))
    side = F.when(low == high, 2).when(F.col("c") == low, 0).otherwise(1)
    mixed = mixed.withColumns({"side": side, "k": F.when(F.col("s") == 1, F.col("k")).otherwise(F.xxhash64("k", low, high))})
    return mixed.drop("s", "c", "o")


def pair_batches(node: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
    keep = node != root
    node, root = node[keep], root[keep]
    for s in range(0, len(node), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + (1 << 16)].astype(np.int64)) for c in (node, root)], ["v", "u"])


def bucket_links(batches: Iterator[pa.RecordBatch], key: str, eps: float, limit: float, digits: int | None = 6) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, x, y, uid) of a task's buckets, some at a time: positions of linked points that join what is near."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    uid, x, y = (t[c].to_numpy() for c in ("_u", "x", "y"))
    _, bucket = np.unique(t[key].to_numpy(), return_inverse=True)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(bucket.max() + 2))
    cuts = np.flatnonzero(np.diff(ends // 200_000)) + 1
    for first, last in zip(np.append(0, cuts), np.append(cuts, bucket.max() + 1)):
        at = order[ends[first] : ends[last]]
        if len(at):
            a, b = cell_links(bucket[at] - first, x[at], y[at], eps, limit, digits)
            yield at[a], at[b], x, y, uid


def cell_rest(nodes: DataFrame, eps: float, hot_bucket: int = 16 * HOT_BUCKET, digits: int | None = 6) -> DataFrame:
    """(v, u): links of at most ``eps`` between different components of nodes (_g, _v, _u, _c), as pairs of components."""
    side, half = GRID * eps, eps / 2 * (1 + 1e-9)
    cells = [F.xxhash64("_g", F.floor((F.col("x") + i * half) / side), F.floor((F.col("y") + j * half) / side)) for i in (-1, 1) for j in (-1, 1)]
    flat = nodes.select("_g", "_u", "_c", F.element_at("_v", 1).alias("x"), F.element_at("_v", 2).alias("y"))
    rows = flat.withColumn("k", F.explode(F.array_distinct(F.array(*cells)))).drop("_g")
    mixed = rows.groupBy("k").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi")).where("lo <> hi").select("k")
    placed = split_hot(Cut(nodes.sparkSession)(rows.join(mixed, "k", "left_semi"), "rest"), hot_bucket)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            comp = pa.Table.from_batches(held)["_c"].to_numpy()
            for a, b, *_ in bucket_links(iter(held), "k", eps, limit, digits):
                yield from pair_batches(*forest(comp[a], comp[b]))

    limit = eps * eps if digits is None else round(eps * eps, digits)
    return placed.repartition(tasks_for(nodes.sparkSession, nodes.count(), TASK_ROWS), "k").mapInArrow(link, "v long, u long")


def point_degrees(nodes: DataFrame, eps: float, digits: int | None = 6) -> DataFrame:
    """(_u, links): the number of records, other than its own copies, within ``eps`` of each node (_g, _v = [x, y], _u, n)."""
    side, reach = GRID * eps, eps * (1 + 1e-6) + 1e-5  # the squared distance is rounded
    cells = [F.struct(F.floor((F.col("x") + i * reach) / side).alias("i"), F.floor((F.col("y") + j * reach) / side).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    flat = nodes.select("_g", "_u", "n", F.element_at("_v", 1).alias("x"), F.element_at("_v", 2).alias("y"))
    placed = flat.withColumn("own", cells[4]).select("*", F.explode(F.array_distinct(F.array(*cells))).alias("t")).select("_g", "t.i", "t.j", "_u", "x", "y", "n", (F.col("own") == F.col("t")).alias("own"))
    limit = eps * eps if digits is None else round(eps * eps, digits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(p.num_rows for p in parts):
            return
        t = pa.Table.from_batches(parts)
        uid, x, y, n, own = (t[c].to_numpy() for c in ("_u", "x", "y", "n", "own"))
        _, bucket = np.unique(np.stack([t[c].to_numpy() for c in ("_g", "i", "j")], axis=1), axis=0, return_inverse=True)
        bucket = bucket.ravel()
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(np.searchsorted(bucket[order], np.arange(bucket.max() + 2)) // 200_000)) + 1
        for first, last in zip(np.append(0, cuts), np.append(cuts, bucket.max() + 1)):
            at = order[np.searchsorted(bucket[order], first) : np.searchsorted(bucket[order], last)]
            if len(at):
                deg = disc_counts(bucket[at] - first, x[at], y[at], n[at], eps, limit, digits) - n[at]
                mine = own[at]
                yield pa.RecordBatch.from_arrays([pa.array(uid[at][mine]), pa.array(deg[mine])], ["_u", "links"])

    rows = nodes.count()
    return placed.repartition(tasks_for(nodes.sparkSession, rows, TASK_ROWS), "_g", "i", "j").mapInArrow(count, "_u long, links long")
