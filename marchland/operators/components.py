"""Connected components of an edge table, in rounds of star operations; every round is written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marchland.session import Cut

ONE_TASK_EDGES = 2_000_000
BATCH = 1 << 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, lowest node of its component) for all nodes of the given edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        li, lj = label[i], label[j]
        open_ = li != lj
        if not open_.any():
            return nodes, nodes[label]
        i, j, li, lj = i[open_], j[open_], li[open_], lj[open_]
        np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
        while (label != (up := label[label])).any():
            label = up


def star_batches(node: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
    keep = node != root
    v, u = node[keep], root[keep]
    for s in range(0, len(v), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(v[s : s + BATCH]), pa.array(u[s : s + BATCH])], ["v", "u"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges to stars; folded now and then, so that a task holds about as many edges as nodes."""
    v, u, held = [], [], 0
    for b in batches:
        v.append(b.column("v").to_numpy()), u.append(b.column("u").to_numpy())
        held += b.num_rows
        if held > 4_000_000:
            node, root = forest(np.concatenate(v), np.concatenate(u))
            v, u, held = [node[node != root]], [root[node != root]], 0
    if v:
        yield from star_batches(*forest(np.concatenate(v), np.concatenate(u)))


def components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, component): the lowest id of the component for every id that has an edge to another one.

    Loops and edges with a null end are ignored, repeated ones count once; an empty table gives an empty result. Each task
    first reduces its edges to stars. Once no more than ``one_task_edges`` are left, one task finishes; until then rounds of
    large and small stars run on whole tables, so no hub, component or table must fit into one place.
    """
    cut = Cut(edges.sparkSession)
    schema = "v long, u long"
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(src, dst).cast("long").alias("v"), F.least(src, dst).cast("long").alias("u"))
    e = cut(e.where("v <> u").mapInArrow(_contract, schema), "edges0")
    n = e.count()
    turn, mark = 0, None
    while n > one_task_edges:
        turn += 1
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = cut(large, f"large{turn}")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(least.select("v", F.col("m").alias("u")))
        new = cut(small.distinct().mapInArrow(_contract, schema), f"edges{turn}")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        cut.drop(f"edges{turn - 1}", f"large{turn}")
        e, n = new, now[0]
        if tuple(now) == mark:
            break
        mark = tuple(now)
    if n <= one_task_edges:
        e = e.coalesce(1).mapInArrow(_contract, schema)
    else:
        e = e.groupBy("v").agg(F.min("u").alias("u"))
    return e.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
