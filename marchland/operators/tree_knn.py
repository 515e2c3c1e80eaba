"""Exact nearest-neighbour search over kd-tree leaves.

A group with more vectors than one task should hold is cut into the leaves of a kd-tree. The tree is fitted on a bounded
sample (``SAMPLE_PER_LEAF`` vectors a leaf, at most ``MAX_LEAVES`` leaves over all groups); every vector is then indexed. Where
that many leaves would still be too large for a task, each is shared out over parts that have its box. A task orders its
leaf's vectors by a finer tree, looks through them from the nearest sub-leaf outwards, and then asks the other leaves that
may still hold nearer ones.

A ``Space`` says where the trees live and how candidates are verified; this one is the vectors' own, in which all bounds are
exact. Others may map the vectors (``place``) and search a leaf in their own way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marchland.session import Cut, tasks_for

MAX_LEAVES = 65_536
SAMPLE_PER_LEAF = 16
LEAF_ROWS = 16_384
TASK_ROWS = 24_000
BATCH = 8_192
ENTRY = "array<struct<d:double,i:bigint>>"


def vectors(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(array.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)


class Tree:
    """A kd-tree by median splits of a sample; leaves are boxes that fill the whole space, each shared by ``parts`` parts."""

    def __init__(self, sample: np.ndarray, leaves: int, parts: int = 1) -> None:
        self.parts = parts
        dim, cut, left, right, inner, boxes = [], [], [], [], [], []

        def grow(pts: np.ndarray, leaves: int, lo: np.ndarray, hi: np.ndarray) -> int:
            """A node's number; a leaf's is -1 - its place."""
            spread = np.ptp(pts, axis=0) if len(pts) else np.zeros(len(lo))
            axis = int(spread.argmax())
            if leaves <= 1 or len(pts) < 2 or spread[axis] <= 0:
                boxes.append((lo, hi))
                return -len(boxes)
            values = np.sort(pts[:, axis])
            at = values[len(values) * (leaves // 2) // leaves]
            if at <= values[0]:
                at = values[values > values[0]][0]
            node = len(dim)
            dim.append(axis), cut.append(at), left.append(0), right.append(0), inner.append((lo, hi))
            below = pts[:, axis] < at
            hi_l, lo_r = hi.copy(), lo.copy()
            hi_l[axis], lo_r[axis] = at, at
            left[node] = grow(pts[below], leaves // 2, lo, hi_l)
            right[node] = grow(pts[~below], leaves - leaves // 2, lo_r, hi)
            return node

        m = sample.shape[1]
        grow(sample, leaves, np.full(m, -np.inf), np.full(m, np.inf))
        self.dim, self.cut, self.left, self.right = np.array(dim, int), np.array(cut, float), np.array(left, int), np.array(right, int)
        self.boxes = boxes
        every = inner + boxes[::-1]  # so that the box of node k, leaves too, is at place k
        self.lo, self.hi = np.array([x[0] for x in every]), np.array([x[1] for x in every])

    def _part(self, uid: np.ndarray) -> np.ndarray:
        return (((uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(self.parts)).astype(np.int64)

    def leaf(self, y: np.ndarray, uid: np.ndarray) -> np.ndarray:
        out = np.full(len(y), 0 if len(self.dim) else -1, np.int64)
        while len(at := np.flatnonzero(out >= 0)):
            node = out[at]
            out[at] = np.where(y[at, self.dim[node]] < self.cut[node], self.left[node], self.right[node])
        leaf = -1 - out
        return leaf if self.parts == 1 else leaf * self.parts + self._part(uid)

    def near(self, y: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf box within the squared limit of the row, by row; only nodes that are near are descended."""
        rows, leaves = [np.zeros(0, int)], [np.zeros(0, int)]
        step = max(1, min(4096, (1 << 22) // max(1, len(self.boxes))))
        for s in range(0, len(y), step):
            part, most = y[s : s + step], limit[s : s + step] * (1 + 1e-9) + 1e-9
            r, node = np.arange(len(part)), np.full(len(part), 0 if len(self.dim) else -1)
            got_r, got_l = [], []
            while len(r):
                ended = node < 0
                got_r.append(r[ended]), got_l.append(-1 - node[ended])
                r, node = np.tile(r[~ended], 2), np.concatenate([self.left[node[~ended]], self.right[node[~ended]]])
                d2 = np.zeros(len(r))
                for k in range(y.shape[1]):
                    v = part[r, k]
                    d2 += np.maximum(0, np.maximum(self.lo[node, k] - v, v - self.hi[node, k])) ** 2
                ok = d2 <= most[r]
                r, node = r[ok], node[ok]
            r, leaf = np.concatenate(got_r), np.concatenate(got_l)
            order = np.lexsort((leaf, r))
            rows.append(r[order] + s), leaves.append(leaf[order])
        r, leaf = np.concatenate(rows), np.concatenate(leaves)
        if self.parts == 1:
            return r, leaf
        return np.repeat(r, self.parts), np.repeat(leaf * self.parts, self.parts) + np.tile(np.arange(self.parts), len(leaf))


class Space:
    """Where trees live: here the vectors' own d dimensions. ``factor`` times a squared distance bounds how far apart, squared,
    the images of two vectors at that distance lie."""

    factor = 1.0

    def __init__(self, d: int) -> None:
        self.d = d

    def place(self, x: np.ndarray) -> np.ndarray:
        return x

    def leaves(self, x: np.ndarray, uid: np.ndarray, digits: int | None = None) -> Leaves:
        return Leaves(x, uid, digits=digits)


def group_trees(rows: DataFrame, space: Space, leaf_rows: int, group: str = "_g", vec: str = "_v", uid: str = "_u") -> dict[int, Tree]:
    """A tree for each group of more than ``leaf_rows`` vectors; a group without one is a single leaf.

    With more than MAX_LEAVES × ``leaf_rows`` vectors in all, leaves are larger and have parts; groups without a tree then have
    at most 1 / MAX_LEAVES of all vectors.
    """
    sizes = rows.groupBy(group).count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    planned = max(leaf_rows, -(-total // MAX_LEAVES))
    # at most total / planned <= MAX_LEAVES groups are that large
    big = {r[group]: r["count"] for r in sizes.where(F.col("count") > planned).collect()}
    if not big:
        return {}
    rate = F.lit(1.5 * SAMPLE_PER_LEAF / planned)
    chosen = rows.where(F.col(group).isin(list(big))) if len(big) <= 1000 else rows.join(F.broadcast(sizes.where(F.col("count") > planned).select(group)), group)
    hashed = (F.xxhash64(F.lit(11), F.col(uid)).cast("double") / F.lit(2.0**64)) + 0.5
    d = space.d

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = space.place(vectors(b.column(1), d))
            ends = pa.array((np.arange(b.num_rows + 1) * y.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["g", "y"])

    sample = chosen.where(hashed < rate).select(group, vec).mapInArrow(project, "g long, y array<double>").toArrow()
    keys = sample["g"].to_numpy()
    y = vectors(sample["y"], len(sample["y"][0])) if len(keys) else np.zeros((0, space.place(np.zeros((1, d))).shape[1]))
    order = np.argsort(keys, kind="stable")
    keys, y = keys[order], y[order]
    out = {}
    for key, n in big.items():
        lo, hi = np.searchsorted(keys, [key, key + 1])
        out[int(key)] = Tree(y[lo:hi], -(-n // planned), -(-planned // leaf_rows))
    return out


def leaves_of(keys: np.ndarray, y: np.ndarray, trees: dict[int, Tree], uid: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.int64)
    order = np.argsort(keys, kind="stable")
    for s, e in runs(keys[order]):
        at = order[s:e]
        if (tree := trees.get(int(keys[at[0]]))) is not None:
            out[at] = tree.leaf(y[at], uid[at])
    return out


def runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of equal keys in sorted arrays."""
    n = len(keys[0])
    if n:
        change = np.zeros(n, bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        at = np.append(np.flatnonzero(change), n)
        yield from zip(at[:-1].tolist(), at[1:].tolist())


def distinct_vectors(df: DataFrame, group: Column, uid: Column, vec: Column, heads: int) -> DataFrame:
    """(_g, _v, _heads, _u): each distinct vector of a group with its lowest ids, at most ``heads``, and the lowest of all."""
    slim = df.select(group.cast("long").alias("_g"), uid.cast("long").alias("_i"), vec.alias("_v")).where(F.col("_g").isNotNull() & F.col("_i").isNotNull())
    rank = F.dense_rank().over(Window.partitionBy("_g", "_v").orderBy("_i"))
    low = slim.withColumn("_r", rank).where(F.col("_r") <= heads)
    return low.groupBy("_g", "_v").agg(F.array_sort(F.collect_set("_i")).alias("_heads")).withColumn("_u", F.element_at("_heads", 1))


def _pick(rows: np.ndarray, d2: np.ndarray, at: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each row that are lowest by (distance, rank), ordered."""
    order = np.lexsort((rank[at], d2, rows))
    rows, d2, at = rows[order], d2[order], at[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], d2[keep], at[keep]


def _exact(q: np.ndarray, x: np.ndarray, rows: np.ndarray, at: np.ndarray, digits: int | None) -> np.ndarray:
    out = np.empty(len(rows))
    for s in range(0, len(rows), 1 << 16):
        out[s : s + (1 << 16)] = ((q[rows[s : s + (1 << 16)]] - x[at[s : s + (1 << 16)]]) ** 2).sum(axis=1)
    return out if digits is None else np.round(out, digits)


def kd_order(y: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of the rows by leaf of a median-split tree."""
    out, stack = [], [np.arange(len(y))]
    while stack:
        at = stack.pop()
        if len(at) <= size:
            out.append(at)
            continue
        part = y[at]
        axis = int(np.ptp(part, axis=0).argmax())
        half = len(at) // 2
        order = np.argpartition(part[:, axis], half)
        stack += [at[order[half:]], at[order[:half]]]
    return out


class Leaves:
    """A task's vectors in kd order, searched in growing steps from the nearest leaf outwards."""

    factor = 1.0

    def __init__(self, x: np.ndarray, uid: np.ndarray, y: np.ndarray | None = None, size: int | None = None, digits: int | None = None) -> None:
        size = size or (64 if x.shape[1] <= 3 else 512)
        self.x, self.uid, self.y, self.digits = x, uid, x if y is None else y, digits
        self.leaves = kd_order(self.y, size) if len(x) else []
        self.rank = np.empty(len(uid), np.int64)
        self.rank[np.argsort(uid, kind="stable")] = np.arange(len(uid))
        self.sq = (x**2).sum(axis=1)
        self.lo, self.hi = np.array([self.y[a].min(axis=0) for a in self.leaves]), np.array([self.y[a].max(axis=0) for a in self.leaves])

    def place(self, q: np.ndarray) -> np.ndarray:
        return q

    def _verify(self, q: np.ndarray, y: np.ndarray, cand: np.ndarray, k: int, skip: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries among the candidates that may belong to the k nearest of the query rows (whose places are y)."""
        x = self.x[cand]
        if x.shape[1] <= 3:
            d2 = sum((q[:, j : j + 1] - x[:, j]) ** 2 for j in range(x.shape[1]))
        else:
            d2 = np.maximum(0, (q**2).sum(axis=1)[:, None] + self.sq[cand] - 2 * (q @ x.T))
        d2[skip[:, None] == self.uid[cand]] = np.inf
        limit = worst
        if len(cand) > k:
            limit = np.minimum(worst, np.partition(d2, k - 1, axis=1)[:, k - 1])
        # the product form loses digits in proportion to the squared lengths
        slack = 1e-5 + 1e-9 * np.abs(np.where(np.isfinite(limit), limit, 0.0))
        if x.shape[1] > 3:
            slack = slack + 1e-14 * x.shape[1] * ((q**2).sum(axis=1) + self.sq[cand].max())
        rows, col = np.nonzero((d2 <= (limit + slack)[:, None]) & np.isfinite(d2))
        at = cand[col]
        return rows, _exact(q, self.x, rows, at, self.digits), at

    def search(self, q: np.ndarray, skip: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, squared distance, position) of each query's k nearest; ``skip`` is the query's own uid, ``within`` an
        upper bound on the squared distance worth reporting."""
        none = (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
        if not len(q) or not self.leaves:
            return none
        y = self.place(q)
        out = []
        for at in kd_order(y, 64 if q.shape[1] <= 3 else 512):
            rows = self._search(q[at], y[at], skip[at], k, np.full(len(at), np.inf) if within is None else within[at])
            out.append((at[rows[0]], rows[1], rows[2]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _search(self, q: np.ndarray, y: np.ndarray, skip: np.ndarray, k: int, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gap = np.maximum(0, np.maximum(self.lo - y.max(axis=0), y.min(axis=0) - self.hi))
        gap = (gap**2).sum(axis=1)
        order = np.argsort(gap, kind="stable")
        best = (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
        at, step, worst = 0, 2, worst.astype(float)
        while at < len(order):
            # the stopping test: no unseen leaf is, in the projection, within reach of any row's k-th distance
            take = order[at : at + step]
            take = take[gap[take] <= self.factor * worst.max() * (1 + 1e-9) + 1e-9]
            if not len(take):
                break
            d2 = np.zeros((len(y), len(take)))
            for j in range(y.shape[1]):
                d2 += np.maximum(0, np.maximum(self.lo[take, j] - y[:, j : j + 1], y[:, j : j + 1] - self.hi[take, j])) ** 2
            live = d2 <= self.factor * worst[:, None] * (1 + 1e-9) + 1e-9
            take, rows_live = take[live.any(axis=0)], np.flatnonzero(live.any(axis=1))
            at, step = at + step, min(step * 2, 16)
            if len(take):
                cand = np.concatenate([self.leaves[t] for t in take])
                rows, dist, pos = self._verify(q[rows_live], y[rows_live], cand, k, skip[rows_live], worst[rows_live])
                best = _pick(np.concatenate([best[0], rows_live[rows]]), np.concatenate([best[1], dist]), np.concatenate([best[2], pos]), self.rank, k)
                full = np.bincount(best[0], minlength=len(q)) >= k
                last = np.full(len(q), -np.inf)
                np.maximum.at(last, best[0], best[1])
                worst = np.where(full, np.minimum(worst, last), worst)
        return best


def _entries(n: int, rows: np.ndarray, d2: np.ndarray, ids: np.ndarray) -> pa.Array:
    """One list of (distance, id) for each of n rows; the input is ordered by row."""
    at = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(d2), pa.array(ids.astype(np.int64))], ["d", "i"])
    return pa.ListArray.from_arrays(pa.array(at), flat)


def _with_heads(n: int, found: tuple[np.ndarray, np.ndarray, np.ndarray], heads: list[np.ndarray], own: list[np.ndarray] | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring vectors to neighbouring ids: each vector stands for its lowest ids, the query's own ones at distance 0."""
    rows, d2, at = found
    sizes = np.array([len(h) for h in heads]) if heads else np.zeros(0, int)
    reps = sizes[at] if len(at) else np.zeros(0, int)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
    pick = np.repeat(starts[at], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) if len(at) else np.zeros(0, int)
    r, d, i = np.repeat(rows, reps), np.repeat(d2, reps), flat[pick]
    if own is not None:
        o = np.array([len(h) for h in own])
        r, d, i = np.concatenate([np.repeat(np.arange(n), o), r]), np.concatenate([np.zeros(o.sum()), d]), np.concatenate([np.concatenate(own) if own else i[:0], i])
    order = np.lexsort((i, d, r))
    r, d, i = r[order], d[order], i[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < most
    return r[keep], d[keep], i[keep]


def nearest_lists(distinct: DataFrame, space: Space, k: int, leaf_rows: int = LEAF_ROWS, digits: int | None = None, others: bool = True) -> DataFrame:
    """(_g, _u, _near): for each distinct vector its k + 1 nearest ids, its own included, as (distance, id) in order. With ``others`` off only a
    vector's own leaf is searched, which is approximate."""
    spark = distinct.sparkSession
    cut = Cut(spark)
    d, most = space.d, k + 1
    trees = group_trees(distinct, space, leaf_rows)
    rows = distinct.count()
    shared = spark.sparkContext.broadcast(trees)  # at most MAX_LEAVES boxes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = leaves_of(b.column("_g").to_numpy(), space.place(vectors(b.column("_v"), d)), shared.value, b.column("_u").to_numpy()) if shared.value else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "_leaf"])

    base = "_g long, _u long, _v array<double>, _heads array<bigint>"
    slim = distinct.select("_g", "_u", "_v", "_heads")
    placed = slim.mapInArrow(place, base + ", _leaf long").repartition(tasks_for(spark, rows, TASK_ROWS), "_g", "_leaf")
    schema = f"_g long, _u long, _v array<double>, _near {ENTRY}, _ask array<bigint>, _limit double"

    def own_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(p.num_rows for p in parts):
            return
        t = pa.Table.from_batches(parts).sort_by([("_g", "ascending"), ("_leaf", "ascending"), ("_u", "ascending")])
        keys, leaf, uid, x = t["_g"].to_numpy(), t["_leaf"].to_numpy(), t["_u"].to_numpy(), vectors(t["_v"], d)
        heads = [np.array(h, np.int64) for h in t["_heads"].to_pylist()]
        for s, e in runs(keys, leaf):
            part = space.leaves(x[s:e], uid[s:e], digits)
            found = part.search(x[s:e], uid[s:e], k)
            order = np.lexsort((found[1], found[0]))
            found = tuple(f[order] for f in found)
            r, dist, ids = _with_heads(e - s, found, heads[s:e], heads[s:e], most)
            count = np.bincount(r, minlength=e - s)
            limit = np.full(e - s, np.inf)
            last = np.cumsum(count) - 1
            full = count >= most
            limit[full] = dist[last[full]]
            tree = shared.value.get(int(keys[s]))
            ask_r, ask_l = (np.zeros(0, int), np.zeros(0, int)) if tree is None else tree.near(space.place(x[s:e]), space.factor * limit)
            other = ask_l != leaf[s]
            ask_r, ask_l = ask_r[other], ask_l[other]
            asks = pa.ListArray.from_arrays(pa.array(np.searchsorted(ask_r, np.arange(e - s + 1)).astype(np.int32)), pa.array(ask_l.astype(np.int64)))
            whole = pa.RecordBatch.from_arrays([pa.array(keys[s:e]), pa.array(uid[s:e]), t["_v"].slice(s, e - s).combine_chunks(), _entries(e - s, r, dist, ids), asks, pa.array(limit)], ["_g", "_u", "_v", "_near", "_ask", "_limit"])
            for o in range(0, e - s, BATCH):
                yield whole.slice(o, BATCH)

    first = cut(placed.mapInArrow(own_leaf, schema), "near")
    if not trees or not others:
        return first.select("_g", "_u", "_near")
    # rows that may have nearer ones in other leaves ask those; only groups cut into leaves have any
    asked = first.where(F.size("_ask") > 0).select("_g", "_u", "_v", F.explode("_ask").alias("_leaf"), "_limit")
    data = slim.where(F.col("_g").isin(list(trees)) if len(trees) <= 1000 else F.lit(True)).mapInArrow(place, base + ", _leaf long")
    both = asked.withColumn("_heads", F.lit(None).cast("array<bigint>")).unionByName(data.withColumn("_limit", F.lit(None).cast("double")))
    n_asked = asked.count()
    both = both.repartition(tasks_for(spark, rows + n_asked, 2 * TASK_ROWS), "_g", "_leaf")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(p.num_rows for p in parts):
            return
        t = pa.Table.from_batches(parts).sort_by([("_g", "ascending"), ("_leaf", "ascending"), ("_u", "ascending")])
        keys, leaf, uid, x = t["_g"].to_numpy(), t["_leaf"].to_numpy(), t["_u"].to_numpy(), vectors(t["_v"], d)
        limit = t["_limit"].to_numpy()
        is_data = np.array(t["_heads"].is_valid().to_numpy())
        heads = t["_heads"]
        for s, e in runs(keys, leaf):
            data_at, ask_at = s + np.flatnonzero(is_data[s:e]), s + np.flatnonzero(~is_data[s:e])
            if not len(data_at) or not len(ask_at):
                continue
            part = space.leaves(x[data_at], uid[data_at], digits)
            own = [np.array(h, np.int64) for h in heads.take(pa.array(data_at)).to_pylist()]
            for o in range(0, len(ask_at), 1 << 15):
                at = ask_at[o : o + (1 << 15)]
                found = part.search(x[at], uid[at], k, limit[at])
                order = np.lexsort((found[1], found[0]))
                r, dist, ids = _with_heads(len(at), tuple(f[order] for f in found), own, None, most)
                hit = np.unique(r)
                near = _entries(len(at), r, dist, ids).take(pa.array(hit))
                out = pa.RecordBatch.from_arrays([pa.array(keys[at[hit]]), pa.array(uid[at[hit]]), near], ["_g", "_u", "_near"])
                for q in range(0, len(hit), BATCH):
                    yield out.slice(q, BATCH)

    more = both.select("_g", "_u", "_v", "_heads", "_leaf", "_limit").mapInArrow(answer, f"_g long, _u long, _near {ENTRY}")
    lists = first.select("_g", "_u", "_near").unionByName(more)
    merged = lists.groupBy("_g", "_u").agg(F.flatten(F.collect_list("_near")).alias("_near"))
    return merged.withColumn("_near", F.slice(F.array_sort("_near"), 1, most))


def nearest_in(queries: DataFrame, base: DataFrame, d: int, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(_u, _near): for each query (_u, _v) its k nearest vectors of base (_u, _v) as (squared distance, id), by distance, then id.

    Exact. Each query asks the leaf it falls into, and then all others within the distance found. The same id in both tables
    doesn't count as its own neighbour.
    """
    spark = queries.sparkSession
    cut = Cut(spark)
    space = Space(d)
    stock = base.select(F.lit(0).cast("long").alias("_g"), "_u", "_v")
    trees = group_trees(stock, space, leaf_rows)
    shared = spark.sparkContext.broadcast(trees)  # at most MAX_LEAVES boxes
    n_base = stock.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value[0].leaf(vectors(b.column("_v"), d), b.column("_u").to_numpy()) if shared.value else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_u"), b.column("_v"), pa.array(leaf)], ["_u", "_v", "_leaf"])

    placed = stock.select("_u", "_v").mapInArrow(place, "_u long, _v array<double>, _leaf long").withColumn("_limit", F.lit(None).cast("double"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(p.num_rows for p in parts):
            return
        t = pa.Table.from_batches(parts).sort_by([("_leaf", "ascending"), ("_u", "ascending")])
        leaf, uid, x, limit = t["_leaf"].to_numpy(), t["_u"].to_numpy(), vectors(t["_v"], d), t["_limit"].to_numpy()
        is_ask = ~np.isnan(limit)
        for s, e in runs(leaf):
            data, ask = s + np.flatnonzero(~is_ask[s:e]), s + np.flatnonzero(is_ask[s:e])
            part = Leaves(x[data], uid[data])
            for o in range(0, len(ask), 1 << 15):
                at = ask[o : o + (1 << 15)]
                r, dist, pos = part.search(x[at], uid[at], k, limit[at])
                order = np.lexsort((uid[data][pos] if len(data) else pos, dist, r))
                r, dist, pos = r[order], dist[order], pos[order]
                out = pa.RecordBatch.from_arrays([pa.array(uid[at]), t["_v"].take(pa.array(at)).combine_chunks(), pa.array(leaf[at]), _entries(len(at), r, dist, uid[data][pos] if len(data) else pos)], ["_u", "_v", "_leaf", "_near"])
                for q in range(0, len(at), BATCH):
                    yield out.slice(q, BATCH)

    schema = f"_u long, _v array<double>, _leaf long, _near {ENTRY}"
    asks = queries.select("_u", "_v").mapInArrow(place, "_u long, _v array<double>, _leaf long").withColumn("_limit", F.lit(float("inf")))
    n = tasks_for(spark, n_base + queries.count(), TASK_ROWS)
    first = cut(asks.unionByName(placed).repartition(n, "_leaf").mapInArrow(answer, schema), "asked")
    if not trees:
        return first.select("_u", "_near")

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limit = b.column("_limit").to_numpy()
            r, leaf = shared.value[0].near(vectors(b.column("_v"), d), limit)
            other = leaf != b.column("_leaf").to_numpy()[r]
            r, leaf = r[other], leaf[other]
            for s in range(0, len(r), BATCH):
                at = pa.array(r[s : s + BATCH])
                yield pa.RecordBatch.from_arrays([b.column("_u").take(at), b.column("_v").take(at), pa.array(leaf[s : s + BATCH]), b.column("_limit").take(at)], ["_u", "_v", "_leaf", "_limit"])

    limit = F.when(F.size("_near") >= k, F.element_at("_near", -1)["d"]).otherwise(F.lit(float("inf")))
    again = first.select("_u", "_v", "_leaf", limit.alias("_limit")).mapInArrow(more, "_u long, _v array<double>, _leaf long, _limit double")
    second = again.unionByName(placed).repartition(n, "_leaf").mapInArrow(answer, schema)
    both = first.select("_u", "_near").unionByName(second.select("_u", "_near"))
    return both.groupBy("_u").agg(F.flatten(F.collect_list("_near")).alias("_near")).withColumn("_near", F.slice(F.array_sort("_near"), 1, k))
