"""A varied subset of given size: two rounds of lazy greedy maximisation of a facility-location objective.

Round one: each leaf of a kd-tree over a group's vectors nominates candidates. It maximises the weighted sum over its records
of the similarity max(0, 1 - d2 / radius2) to the nearest nominee, and goes on until every record has a nominee within the
radius. Round two: a greedy pass over a group's nominees, each standing for the records it serves, picks the given number.
Where a group has more nominees than one task takes, they are merged in a tree: blocks of nominees each pick that number,
until what is left fits into one pass; a turn leaves at most a quarter of them.

Then the picks are held against all records, leaf by leaf: records that none reaches go through a greedy pass of the same
objective, whose picks join the subset. A pick that stands for itself alone is asked for in all leaves within the radius; if
there is no other record, nobody else gives its coverage, and any subset that reaches every record must hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marchland.llm.index import PRINCIPAL, PROJECTED, Principal, principal
from marchland.operators.tree_knn import Space, group_trees, leaves_of, runs, vectors
from marchland.session import Cut, tasks_for

LEAF_ROWS = 1024
MAX_SIZE = 2048
TASK_ROWS = 16_384
CANDIDATE = "_g long, _u long, _v array<double>, n long"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, to 6 decimals."""
    if a.shape[1] <= 3:
        d2 = sum((a[:, j : j + 1] - b[:, j]) ** 2 for j in range(a.shape[1]))
    else:
        d2 = np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T))
    return np.round(d2, 6)


def similarity(x: np.ndarray, radius2: float, least: float = 0.0) -> np.ndarray:
    """1 at the same place, 0 beyond the radius, and at least ``least`` within it."""
    d2 = squared(x, x)
    sim = np.maximum(least, 1 - d2 / radius2)
    sim[d2 > radius2] = 0
    return sim.astype(np.float32)


def lazy_greedy(sim: np.ndarray, weight: np.ndarray, size: int, cover: bool) -> list[int]:
    """Positions picked: ``size`` by gain, then, if asked, as many as it takes to serve every row; ties take the first.

    ``sim`` is symmetric. A gain only falls as picks are made, so an old gain bounds the new one.
    """
    picked: list[int] = []
    best = np.zeros(len(weight), sim.dtype)
    goal = weight.astype(sim.dtype)
    bound = goal @ sim
    only_open = False
    while True:
        if len(picked) >= size:
            open_ = best <= 0
            if not cover or not open_.any():
                return picked
            goal = np.where(open_, weight, 0).astype(sim.dtype)
            if not only_open:  # from here on only rows that nobody serves count
                only_open = True
                bound = goal[open_] @ sim[open_]
        j = int(bound.argmax())
        if bound[j] <= 0:
            return picked
        gain = float(goal @ np.maximum(0, sim[j] - best))
        bound[j] = 0
        if gain <= 0:
            continue
        if gain >= bound.max():  # no other bound is higher, so no other gain is
            picked.append(j)
            best = np.maximum(best, sim[j])
        else:
            bound[j] = gain


def _read(batches: Iterator[pa.RecordBatch], *by: str) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in by]) if parts else None


def _nominate(radius2: float, size: int, cover: bool, rows: int):
    """Nominees of each (_g, _leaf) run of a task, taken in parts of at most ``rows``; n is the number of records served."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := _read(batches, "_g", "_leaf", "_u")) is None:
            return
        g, leaf, uid, n = (t[c].to_numpy() for c in ("_g", "_leaf", "_u", "n"))
        x = vectors(t["_v"], len(t["_v"][0]))
        for lo, hi in runs(g, leaf):
            for s in range(lo, hi, rows):
                e = min(hi, s + rows)
                sim = similarity(x[s:e], radius2, 1e-6)
                picked = np.array(lazy_greedy(sim, n[s:e], size, cover), np.int64)
                served = sim[picked]
                serves = np.bincount(served.argmax(axis=0), np.where(served.max(axis=0) > 0, n[s:e], 0), len(picked)).astype(np.int64)
                out = s + picked
                yield pa.RecordBatch.from_arrays([pa.array(g[out]), pa.array(uid[out]), t["_v"].take(pa.array(out)).combine_chunks(), pa.array(serves)], ["_g", "_u", "_v", "n"])

    return run


def _fill_up(radius2: float, cover: bool):
    """Of each (_g, _leaf) run: the records that picks (asks) stand for, and more picks for those that none reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := _read(batches, "_g", "_leaf", "_u")) is None:
            return
        g, leaf, uid, n, asks = (t[c].to_numpy() for c in ("_g", "_leaf", "_u", "n", "asks"))
        x = vectors(t["_v"], len(t["_v"][0]))
        for s, e in runs(g, leaf):
            q, data = s + np.flatnonzero(asks[s:e]), s + np.flatnonzero(~asks[s:e])
            serves, left = np.zeros(len(q), np.int64), [data[:0]]
            for a in range(0, len(data), 2048):
                i = data[a : a + 2048]
                best, nearest = np.full(len(i), np.inf), np.zeros(len(i), np.int64)
                for b in range(0, len(q), 4096):
                    d2 = squared(x[i], x[q[b : b + 4096]])
                    k = d2.argmin(axis=1)
                    low = d2[np.arange(len(i)), k]
                    nearest = np.where(low < best, b + k, nearest)
                    best = np.minimum(best, low)
                np.add.at(serves, nearest[best <= radius2], n[i[best <= radius2]])
                left.append(i[best > radius2])
            out, counts, open_ = [q], [serves], np.concatenate(left)
            for a in range(0, len(open_) if cover else 0, 2 * LEAF_ROWS):
                i = open_[a : a + 2 * LEAF_ROWS]
                sim = similarity(x[i], radius2, 1e-6)
                picked = np.array(lazy_greedy(sim, n[i], 0, True), np.int64)
                out.append(i[picked])
                counts.append(np.bincount(sim[picked].argmax(axis=0), n[i], len(picked)).astype(np.int64))
            at = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(uid[at]), pa.array(np.concatenate(counts))], ["_g", "_u", "stands_for"])

    return run


def _met(radius2: float):
    """The asked ids that have another record within the radius in this (_g, _leaf) run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := _read(batches, "_g", "_leaf")) is None:
            return
        g, leaf, uid, asks = (t[c].to_numpy() for c in ("_g", "_leaf", "_u", "asks"))
        x = vectors(t["_v"], len(t["_v"][0]))
        for s, e in runs(g, leaf):
            q, data = s + np.flatnonzero(asks[s:e]), s + np.flatnonzero(~asks[s:e])
            hit = np.zeros(len(q), bool)
            for a in range(0, len(q), 1024):
                for b in range(0, len(data), 4096):
                    i, j = q[a : a + 1024], data[b : b + 4096]
                    hit[a : a + 1024] |= ((squared(x[i], x[j]) <= radius2) & (uid[i][:, None] != uid[j])).any(axis=1)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(uid[q[hit]])], ["_u"])

    return run


def varied_subset(df: DataFrame, group: Column, uid: Column, vec: list[Column], radius2: float, size: int, leaf_rows: int = LEAF_ROWS, cover: bool = True) -> DataFrame:
    """(group, id, must, stands_for): per group the ``size`` picks of the two rounds, and then (``cover``) as many as it takes for
    every record to lie within the squared distance ``radius2``, rounded to 6 decimals, of one in the result. stands_for is
    the number of records of which a pick is the nearest within the radius; must marks picks that no other record of the
    group lies that near to, so that any subset reaching every record holds them.

    Rows with a null group, id or component, or a NaN one, take no part. Rows repeated under one id count once; equal records
    are one choice, under their lowest id. A group of fewer distinct records than ``size`` (at most MAX_SIZE) may give them
    all. An empty table gives an empty result.
    """
    if not 0 < size <= MAX_SIZE:
        raise ValueError(f"between 1 and {MAX_SIZE} records can be picked for a group; use finer groups for more")
    spark = df.sparkSession
    cut = Cut(spark)
    d = len(vec)
    usable = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c.cast("double")) for c in vec], group.isNotNull() & uid.isNotNull())
    slim = df.where(usable).select(group.cast("long").alias("_g"), uid.cast("long").alias("id"), F.array(*[c.cast("double") + F.lit(0.0) for c in vec]).alias("_v"))
    nodes = cut(slim.dropDuplicates(["id"]).groupBy("_g", "_v").agg(F.min("id").alias("_u"), F.count(F.lit(1)).alias("n")), "nodes")
    space = Space(d) if d <= PROJECTED else Principal(principal(nodes, d, PRINCIPAL // 2))
    trees = group_trees(nodes, space, leaf_rows)
    shared = spark.sparkContext.broadcast(trees)  # at most MAX_LEAVES boxes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = leaves_of(b.column("_g").to_numpy(), space.place(vectors(b.column("_v"), d)), shared.value, b.column("_u").to_numpy()) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "_leaf"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row once for every leaf of its group within the radius."""
        for b in batches:
            g, y = b.column("_g").to_numpy(), space.place(vectors(b.column("_v"), d))
            for key in np.unique(g):
                at = np.flatnonzero(g == key)
                if (tree := shared.value.get(int(key))) is None:
                    r, leaf = at, np.zeros(len(at), np.int64)
                else:
                    r, leaf = tree.near(y[at], np.full(len(at), radius2))
                    r = at[r]
                for s in range(0, len(r), 8192):
                    part = pa.array(r[s : s + 8192])
                    yield pa.RecordBatch.from_arrays([b.column("_g").take(part), b.column("_u").take(part), b.column("_v").take(part), pa.array(leaf[s : s + 8192])], ["_g", "_u", "_v", "_leaf"])

    rows = nodes.count()
    n_tasks = tasks_for(spark, rows, TASK_ROWS)
    placed = cut(nodes.select("_g", "_u", "_v", "n").mapInArrow(place, CANDIDATE + ", _leaf long").repartition(n_tasks, "_g", "_leaf"), "placed")
    by_leaf = placed.repartition(n_tasks, "_g", "_leaf")
    left = cut(by_leaf.mapInArrow(_nominate(radius2, size, True, 2 * LEAF_ROWS), CANDIDATE), "round1")

    block = max(LEAF_ROWS, 4 * size)
    turn = 0
    while True:
        over = left.groupBy("_g").count().where(F.col("count") > 2 * block).select("_g", F.ceil(F.col("count") / block).alias("blocks"))
        if over.limit(1).count() == 0:
            break
        turn += 1
        split = left.join(over, "_g", "left")
        many = split.where("blocks is not null").select("_g", "_u", "_v", "n", F.pmod(F.xxhash64(F.lit(turn), "_u"), F.col("blocks")).alias("_leaf"))
        many = many.repartition(tasks_for(spark, rows // 16, TASK_ROWS), "_g", "_leaf").mapInArrow(_nominate(4 * radius2, size, False, 2 * block), CANDIDATE)
        left = cut(many.unionByName(split.where("blocks is null").select("_g", "_u", "_v", "n")), f"merge{turn}")
    final = left.withColumn("_leaf", F.lit(0).cast("long")).repartition(tasks_for(spark, 1, 1), "_g").mapInArrow(_nominate(4 * radius2, size, False, 2 * block), CANDIDATE)

    picks = cut(final.select("_g", "_u", "_v"), "picks")
    asked = picks.mapInArrow(ask, "_g long, _u long, _v array<double>, _leaf long").select("*", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks"))
    data = placed.select("_g", "_u", "_v", "_leaf", "n", F.lit(False).alias("asks"))
    counted = asked.unionByName(data).repartition(n_tasks, "_g", "_leaf").mapInArrow(_fill_up(radius2, cover), "_g long, _u long, stands_for long")
    subset = cut(counted.groupBy("_g", "_u").agg(F.sum("stands_for").alias("stands_for")), "subset")

    alone = subset.where("stands_for = 1").join(nodes.where("n = 1").select("_u", "_v"), "_u").select("_g", "_u", "_v")
    asked = alone.mapInArrow(ask, "_g long, _u long, _v array<double>, _leaf long").withColumn("asks", F.lit(True))
    met = asked.unionByName(data.select(asked.columns)).repartition(n_tasks, "_g", "_leaf").mapInArrow(_met(radius2), "_u long").distinct()
    marked = subset.join(alone.select("_u", F.lit(True).alias("_alone")), "_u", "left").join(met.withColumn("_met", F.lit(True)), "_u", "left")
    must = F.col("_alone").isNotNull() & F.col("_met").isNull()
    return marked.select(F.col("_g").alias("group"), F.col("_u").alias("id"), must.alias("must"), "stands_for")
