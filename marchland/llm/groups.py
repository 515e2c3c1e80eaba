"""Clusters of mutually similar records with their sizes and most typical members.

Each record becomes a set of tokens, MinHash bands of the sets give candidate pairs, the exact Jaccard similarity and then
the exact distance verify them, connected components form the clusters, and loose clusters are split around their members
of highest degree.

Tokens are pairs of attribute and value for integer records, and for points the cells of a fine grid around the point (a
disc of twice the distance), so that near points share most of them. The hash families are seeded and random, so some links
are missed; an exact pass then looks for links between the components found: records that differ in at most t attributes
agree in 2 of t + 2 blocks of attributes, and points within the distance have boxes of half of it that meet in a coarse
cell. Only blocks and cells with more than one component are looked through. ``link_shares`` tells how much each pass joined.

Exact copies are one node. A bucket's links leave its task as a spanning forest, never as all pairs; a bucket with too many
records is cut into chunks, and each pair of chunks is a bucket of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marchland.operators.components import components, forest
from marchland.operators.dense import HOT_BUCKET, PAIRS, TASK_ROWS, bucket_links, cell_rest, pair_batches, point_degrees, split_hot
from marchland.operators.tree_knn import runs, vectors
from marchland.session import Cut, tasks_for

BANDS, ROWS = 8, 6
POINT_BANDS = 2
SEED = 17


def _mix(v: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes of unsigned integers."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _family(count: int) -> np.ndarray:
    """Seeds of ``count`` hash functions: the function j of a token is _mix(token ^ seed j)."""
    return np.random.default_rng(SEED).integers(1, 1 << 63, count, dtype=np.int64).astype(np.uint64)


def attribute_signatures(g: np.ndarray, f: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """n × bands keys of integer records: MinHash of the (attribute, value) tokens, ``rows`` minima a band."""
    seeds = _family(bands * rows)
    low = np.full((len(f), bands * rows), np.iinfo(np.uint64).max, np.uint64)
    for j in range(f.shape[1]):
        values, at = np.unique(f[:, j], return_inverse=True)
        tokens = _mix(values.astype(np.int64).astype(np.uint64) * np.uint64(4096) + np.uint64(j + 1))
        np.minimum(low, _mix(tokens[:, None] ^ seeds)[at.ravel()], out=low)
    return _band_keys(g, low.reshape(len(f), bands, rows))


def _band_keys(g: np.ndarray, low: np.ndarray) -> np.ndarray:
    key = _mix(np.repeat(g.astype(np.uint64)[:, None], low.shape[1], axis=1) + np.arange(low.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for r in range(low.shape[2]):
        key = _mix(key * np.uint64(31) + low[:, :, r])
    return key.astype(np.int64)


def disc_offsets() -> np.ndarray:
    """Cells of a disc of four cells' radius around a cell: the tokens of a point, relative to its own cell."""
    i, j = np.meshgrid(np.arange(-4, 5), np.arange(-4, 5), indexing="ij")
    return np.stack([i[i * i + j * j <= 16], j[i * i + j * j <= 16]], axis=1)


def disc_jaccard() -> dict[tuple[int, int], float]:
    """Jaccard similarity of the token sets of two cells by the offset between them."""
    disc = {tuple(o) for o in disc_offsets().tolist()}
    out = {}
    for di in range(-8, 9):
        for dj in range(-8, 9):
            both = len(disc & {(i + di, j + dj) for i, j in disc})
            out[di, dj] = both / (2 * len(disc) - both)
    return out


def point_signatures(g: np.ndarray, cx: np.ndarray, cy: np.ndarray, bands: int = POINT_BANDS) -> np.ndarray:
    """n × bands keys of points by their fine cell: one minimum a band."""
    cells, at = np.unique(np.stack([cx, cy], axis=1), axis=0, return_inverse=True)
    seeds = _family(bands)
    low = np.full((len(cells), bands), np.iinfo(np.uint64).max, np.uint64)
    for i, j in disc_offsets():
        tokens = _mix(_mix((cells[:, 0] + i).astype(np.uint64)) + (cells[:, 1] + j).astype(np.uint64))
        np.minimum(low, _mix(tokens[:, None] ^ seeds), out=low)
    return _band_keys(g, low[at.ravel()][:, :, None])


def point_links(nodes: DataFrame, eps: float, hot_bucket: int = 16 * HOT_BUCKET) -> DataFrame:
    """(v, u) from nodes (_g, _v = [x, y], _u): a spanning forest of the links of at most ``eps`` within MinHash bands."""
    fine, limit = eps / 2, round(eps * eps, 6)
    jaccard = disc_jaccard()
    # a pair within the distance lies at most three cells apart on an axis, and no farther than that on the plane
    least = min(v for (i, j), v in jaccard.items() if max(0, abs(i) - 1) ** 2 + max(0, abs(j) - 1) ** 2 <= 4 + 1e-6)
    flat = nodes.select("_g", "_u", F.element_at("_v", 1).alias("x"), F.element_at("_v", 2).alias("y"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            keys = point_signatures(b.column("_g").to_numpy(), np.floor(x / fine).astype(np.int64), np.floor(y / fine).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(keys)], [*b.schema.names, "keys"])

    signed = flat.mapInArrow(sign, "_g long, _u long, x double, y double, keys array<bigint>").select("_u", "x", "y", F.explode("keys").alias("k"))
    placed = split_hot(Cut(nodes.sparkSession)(signed, "bands"), hot_bucket)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, x, y, uid in bucket_links(batches, "k", eps, limit):
            offset = np.stack([np.floor(x[b] / fine) - np.floor(x[a] / fine), np.floor(y[b] / fine) - np.floor(y[a] / fine)], axis=1).astype(int)
            shift, at = np.unique(offset, axis=0, return_inverse=True)
            alike = np.array([jaccard.get(tuple(o), 0.0) >= least for o in shift.tolist()])[at.ravel()]
            yield from pair_batches(*forest(uid[a[alike]], uid[b[alike]]))

    return placed.repartition(tasks_for(nodes.sparkSession, POINT_BANDS * nodes.count(), 4 * TASK_ROWS), "k").mapInArrow(link, "v long, u long")


def _lists(keys: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(keys) + 1) * keys.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(keys).ravel()))


def bands(attributes: int, differ: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Blocks of attributes, and the pairs of blocks that are the bands."""
    blocks = [b.tolist() for b in np.array_split(np.arange(attributes), min(attributes, differ + 2))]
    if len(blocks) < differ + 2:
        raise ValueError("records need at least two attributes more than may differ")
    return blocks, list(combinations(range(len(blocks)), 2))


def block_keys(g: np.ndarray, f: np.ndarray, differ: int) -> np.ndarray:
    """n × bands keys: one for each pair of blocks of attributes, of which near records share at least one."""
    blocks, pairs = bands(f.shape[1], differ)
    of_block = []
    for b in blocks:
        h = g.astype(np.uint64)
        for j in b:
            h = _mix(h * np.uint64(31) + f[:, j].astype(np.int64).astype(np.uint64) + np.uint64(j + 1))
        of_block.append(h)
    return np.stack([_mix(of_block[p] * np.uint64(31) + of_block[q] + np.uint64(i)) for i, (p, q) in enumerate(pairs)], axis=1).astype(np.int64)


def _keyed(nodes: DataFrame, attributes: int, keys, *more: str) -> DataFrame:
    """(k, b, _g, _u, n, _p, more): each node once for each of its keys; _p packs its integers and the other components."""
    width = F.size("_v")
    schema = "_g long, _u long, n long, " + "".join(f"{m} long, " for m in more) + "_p binary, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors(b.column("_v"), len(b.column("_v")[0]))
            whole, rest = x[:, :attributes], x[:, attributes:]
            if np.abs(whole).max() > 32_767 or (whole != np.round(whole)).any():
                raise ValueError("the attributes must be integers of at most 16 bits")
            f = whole.astype(np.int16)
            raw = np.concatenate([np.ascontiguousarray(f).view(np.uint8), np.ascontiguousarray(rest).view(np.uint8).reshape(len(x), -1)], axis=1)
            ends = (np.arange(len(x) + 1) * raw.shape[1]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("_g", "_u", "n", *more)], packed, _lists(keys(b.column("_g").to_numpy(), f))], ["_g", "_u", "n", *more, "_p", "keys"])

    slim = nodes.where(width > 0).select("_g", "_u", "n", *more, "_v").mapInArrow(run, schema)
    return slim.select("_g", "_u", "n", *more, "_p", F.posexplode("keys").alias("b", "k"))


def _unpack(t: pa.Table, attributes: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(t["_p"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
    f = np.ascontiguousarray(raw[:, : 2 * attributes]).view(np.int16)
    return f, np.ascontiguousarray(raw[:, 2 * attributes :]).view(np.float64).reshape(len(f), -1)


def _near_pairs(key: np.ndarray, f: np.ndarray, r: np.ndarray, limit: float, least: float, may: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of one bucket (rows are sorted by it) that ``may`` meet, are as similar as ``least`` by the exact Jaccard
    similarity of their tokens, and lie within the squared distance ``limit``."""
    attributes = f.shape[1]

    def verified(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = may(a, b)
        a, b = a[ok], b[ok]
        matched = (f[a] == f[b]).sum(axis=1)
        ok = matched / (2 * attributes - matched) >= least
        a, b = a[ok], b[ok]
        d2 = ((f[a].astype(float) - f[b]) ** 2).sum(axis=1) + ((r[a] - r[b]) ** 2).sum(axis=1)
        ok = np.round(d2, 6) <= limit
        return a[ok], b[ok]

    start = np.array([s for s, _ in runs(key)])
    size = np.diff(np.append(start, len(key)))
    # small buckets: all their pairs at once, in chunks; larger ones block by block
    small_ = (size > 1) & (size <= 512)
    st, sz = start[small_], size[small_]
    n_pairs = sz * (sz - 1) // 2
    for part in np.split(np.arange(len(st)), np.flatnonzero(np.diff(np.cumsum(n_pairs) // PAIRS)) + 1) if len(st) else []:
        rows = np.concatenate([np.arange(s, s + z - 1) for s, z in zip(st[part], sz[part])])
        left = np.concatenate([np.arange(z - 1, 0, -1) for z in sz[part]])
        a = np.repeat(rows, left)
        yield verified(a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left))
    for s, z in zip(start[size > 512], size[size > 512]):
        x = np.concatenate([f[s : s + z].astype(float), r[s : s + z]], axis=1)
        sq = (x**2).sum(axis=1)
        for o in range(0, z, 512):
            d2 = sq[o : o + 512, None] + sq[None, o:] - 2 * (x[o : o + 512] @ x[o:].T)
            i, j = np.nonzero(d2 <= limit + 1e-6)
            up = j > i
            for q in range(0, int(up.sum()), PAIRS):
                yield verified(s + o + i[up][q : q + PAIRS], s + o + j[up][q : q + PAIRS])


class _Forest:
    """Edges of a task, kept about as few as the nodes they join."""

    def __init__(self) -> None:
        self.a, self.b, self.held = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a), self.b.append(b)
        self.held += len(a)
        if self.held > 4 * PAIRS:
            node, root = self.done()
            self.a, self.b, self.held = [node], [root], 0

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate(self.a), np.concatenate(self.b)) if self.a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _least_jaccard(attributes: int, limit: float) -> float:
    differ = math.floor(limit)
    return (attributes - differ) / (attributes + differ)


def minhash_links(nodes: DataFrame, attributes: int, limit: float, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(v, u) from nodes (_g, _v, _u, n): a spanning forest of the links within MinHash bands. The first ``attributes`` components
    are integers that add at least 1 to a squared distance where they differ."""
    placed = split_hot(Cut(nodes.sparkSession)(_keyed(nodes, attributes, attribute_signatures), "bands"), hot_bucket)
    least = _least_jaccard(attributes, limit)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by("k")
        key, uid, side, g = (t[c].to_numpy() for c in ("k", "_u", "side", "_g"))
        f, r = _unpack(t, attributes)
        held = _Forest()
        for a, b in _near_pairs(key, f, r, limit, least, lambda a, b: (uid[a] != uid[b]) & (g[a] == g[b]) & ((side[a] == 2) | (side[a] != side[b]))):
            held.add(uid[a], uid[b])
        yield from pair_batches(*held.done())

    return placed.repartition(tasks_for(nodes.sparkSession, BANDS * nodes.count(), 4 * TASK_ROWS), "k").mapInArrow(link, "v long, u long")


def block_rest(nodes: DataFrame, attributes: int, limit: float, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(v, u): links between different components of nodes (_g, _v, _u, n, _c), as pairs of components."""
    differ = math.floor(limit)
    cut = Cut(nodes.sparkSession)
    rows = cut(_keyed(nodes, attributes, lambda g, f: block_keys(g, f, differ), "_c"), "blocks")
    mixed = rows.groupBy("k").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi")).where("lo <> hi").select("k")
    placed = split_hot(cut(rows.join(mixed, "k", "left_semi"), "rest"), hot_bucket)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by("k")
        key, comp, side, g = (t[c].to_numpy() for c in ("k", "_c", "side", "_g"))
        f, r = _unpack(t, attributes)
        held = _Forest()
        for a, b in _near_pairs(key, f, r, limit, 0.0, lambda a, b: (comp[a] != comp[b]) & (g[a] == g[b]) & ((side[a] == 2) | (side[a] != side[b]))):
            held.add(comp[a], comp[b])
        yield from pair_batches(*held.done())

    return placed.repartition(tasks_for(nodes.sparkSession, nodes.count(), TASK_ROWS), "k").mapInArrow(link, "v long, u long")


def attribute_degrees(nodes: DataFrame, attributes: int, limit: float, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(_u, links): the number of records, other than its own copies, linked to each node (_g, _v, _u, n) that has any. Exact: a pair
    is counted in the first pair of blocks it shares."""
    differ = math.floor(limit)
    blocks, pairs = bands(attributes, differ)
    placed = split_hot(Cut(nodes.sparkSession)(_keyed(nodes, attributes, lambda g, f: block_keys(g, f, differ)), "blocks"), hot_bucket)
    edges = np.array([b[0] for b in blocks])
    number = np.full((len(blocks), len(blocks)), -1)
    for i, p in enumerate(pairs):
        number[p] = i

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by("k")
        key, uid, band, side, g, n = (t[c].to_numpy() for c in ("k", "_u", "b", "side", "_g", "n"))
        f, r = _unpack(t, attributes)
        links = np.zeros(len(uid), np.int64)
        for a, b in _near_pairs(key, f, r, limit, 0.0, lambda a, b: (uid[a] != uid[b]) & (g[a] == g[b]) & ((side[a] == 2) | (side[a] != side[b]))):
            if len(a):
                whole = np.logical_and.reduceat(f[a] == f[b], edges, axis=1)
                p0 = np.argmax(whole, axis=1)
                whole[np.arange(len(a)), p0] = False
                once = number[p0, np.argmax(whole, axis=1)] == band[a]
                np.add.at(links, a[once], n[b[once]])
                np.add.at(links, b[once], n[a[once]])
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(links[some])], ["_u", "links"])

    rows = nodes.count() * len(pairs)
    counted = placed.repartition(tasks_for(nodes.sparkSession, rows, 4 * TASK_ROWS), "k").mapInArrow(count, "_u long, links long")
    return counted.groupBy("_u").agg(F.sum("links").alias("links"))


def cluster_nodes(df: DataFrame, group: Column, uid: Column, vec: list[Column], attributes: int, eps2: float) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): members (_g, id, _u) of each usable record, nodes (_g, _u, _v, n, _c, first_id), one for each distinct
    vector; _c is its component by MinHash links alone. ``attributes`` 0 takes the two components as a point."""
    cut = Cut(df.sparkSession)
    if not attributes and len(vec) != 2:
        raise ValueError("points have two components")
    usable = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c.cast("double")) for c in vec], group.isNotNull() & uid.isNotNull())
    slim = df.where(usable).select(group.cast("long").alias("_g"), uid.cast("long").alias("id"), F.array(*[c.cast("double") + F.lit(0.0) for c in vec]).alias("_v"))
    slim = cut(slim.dropDuplicates(["id"]), "records")
    nodes = cut(slim.groupBy("_g", "_v").agg(F.min("id").alias("_u"), F.count(F.lit(1)).alias("n")), "nodes")
    links = minhash_links(nodes, attributes, eps2) if attributes else point_links(nodes, math.sqrt(eps2))
    comp = components(links, "v", "u").select(F.col("id").alias("_u"), F.col("component").alias("_c"))
    nodes = cut(nodes.join(comp, "_u", "left").withColumn("_c", F.coalesce("_c", "_u")).select("_g", "_u", "_v", "n", "_c"), "banded")
    rest = block_rest(nodes, attributes, eps2) if attributes else cell_rest(nodes, math.sqrt(eps2))
    last = components(rest, "v", "u").select(F.col("id").alias("_c"), F.col("component").alias("_f"))
    nodes = cut(nodes.join(last, "_c", "left").select("_g", "_u", "_v", "n", "_c", F.coalesce("_f", "_c").alias("first_id")), "clustered")
    several = slim.join(nodes.where("n > 1").select("_g", "_v", "_u"), ["_g", "_v"]).select("_g", "id", "_u")
    members = nodes.where("n = 1").select("_g", F.col("_u").alias("id"), "_u").unionByName(several)
    return members, nodes


def link_shares(df: DataFrame, group: Column, uid: Column, vec: list[Column], attributes: int, eps2: float) -> DataFrame:
    """One row (vectors, banded, clusters, share): how many components distinct vectors form by MinHash links alone and in the end,
    and the share of all joins that the bands made."""
    _, nodes = cluster_nodes(df, group, uid, vec, attributes, eps2)
    sizes = nodes.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.first("first_id").alias("f")).groupBy("f").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    totals = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.coalesce(F.sum("m"), F.lit(0)).alias("banded"), F.count(F.lit(1)).alias("clusters"))
    return totals.withColumn("share", F.when(F.col("vectors") > F.col("clusters"), (F.col("vectors") - F.col("banded")) / (F.col("vectors") - F.col("clusters"))))


def similarity_clusters(df: DataFrame, group: Column, uid: Column, vec: list[Column], attributes: int, eps2: float, least: int = 3) -> DataFrame:
    """(first_id, member_id): records of one group that are linked by a chain of squared distances of at most ``eps2`` (rounded to
    6 decimals), for each cluster of ``least`` records or more; first_id is its lowest id and has no row of its own.

    Rows with a null group, id or component, or a NaN one, take no part; rows repeated under one id count once, equal records
    under several ids are linked. Empty tables give an empty result.
    """
    members, nodes = cluster_nodes(df, group, uid, vec, attributes, eps2)
    big = nodes.groupBy("first_id").agg(F.sum("n").alias("size")).where(F.col("size") >= least).select("first_id")
    lone = nodes.where("n = 1").join(big, "first_id").select("first_id", F.col("_u").alias("member_id"))
    several = members.alias("m").join(nodes.where("n > 1").select("_u", "first_id").join(big, "first_id").alias("k"), "_u").select("first_id", F.col("id").alias("member_id"))
    return lone.unionByName(several).where(F.col("first_id") != F.col("member_id"))


def describe_clusters(df: DataFrame, group: Column, uid: Column, vec: list[Column], attributes: int, eps2: float, least: int = 3, tight: float = 0.2, parts: int = 8) -> DataFrame:
    """(group, first_id, medoid_id, size, loose, typical): the clusters, loose ones split into parts around their medoids.

    A record's degree is its number of linked records (copies included). A cluster or part of 50 records or more is loose if its
    best member is linked to less than ``tight`` of it; then medoids are taken one by one from all its members, up to ``parts``:
    each time the member of highest degree more than three distances from all taken before. Each record joins the nearest
    medoid, and loose parts are split again until none is left that has a member that far from its medoid. ``loose`` says that
    the cluster was split; ``typical`` lists the 3 members of highest degree; ties take the lower id.
    """
    _, nodes = cluster_nodes(df, group, uid, vec, attributes, eps2)
    cut = Cut(df.sparkSession)
    degrees = attribute_degrees(nodes, attributes, eps2) if attributes else point_degrees(nodes, math.sqrt(eps2))
    size = nodes.groupBy("first_id").agg(F.sum("n").alias("size")).where(F.col("size") >= least).select("first_id")
    graded = nodes.join(size, "first_id").join(degrees, "_u", "left").withColumn("deg", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    graded = cut(graded.select("_g", "_u", "_v", "n", "deg", "first_id"), "graded")
    dist = lambda v, w: F.aggregate(F.zip_with(v, w, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)
    best = lambda: F.max_by(F.struct(F.col("_u").alias("u"), F.col("_v").alias("v")), F.struct("deg", -F.col("_u")))
    loose = (F.col("size") >= 50) & (F.col("top") + 1 < tight * F.col("size"))

    def parted(members: DataFrame, name: str) -> DataFrame:
        """Of each part its medoid, and whether it is loose."""
        sums = members.groupBy("first_id", "part").agg(F.sum("n").alias("size"), F.max("deg").alias("top"), best().alias("m"))
        return cut(sums.select("first_id", "part", "m", loose.alias("loose")), name)

    open_ = graded.withColumn("part", F.col("first_id"))
    sums = parted(open_, "sums0")
    done = open_.join(sums.where("not loose"), ["first_id", "part"]).select("_g", "_u", "n", "deg", "first_id", F.col("m.u").alias("medoid_id"), F.lit(False).alias("loose"))
    level = 0
    while sums.where("loose").limit(1).count():
        level += 1
        open_ = cut(open_.join(sums.where("loose").select("first_id", "part"), ["first_id", "part"]).select("_g", "_u", "_v", "n", "deg", "first_id", "part"), f"loose{level}")
        medoids = newest = sums.where("loose").select("first_id", "part", "m")
        far = open_.select("_u", "_v", "deg", "first_id", "part")
        for turn in range(1, parts):
            far = cut(far.join(newest, ["first_id", "part"]).where(dist(F.col("m.v"), F.col("_v")) > 9 * eps2).drop("m"), f"far{level}_{turn}")
            newest = cut(far.groupBy("first_id", "part").agg(best().alias("m")), f"medoids{level}_{turn}")
            if newest.limit(1).count() == 0:
                break
            medoids = medoids.unionByName(newest)
        chosen = medoids.groupBy("first_id", "part").agg(F.collect_list("m").alias("m"))
        nearest = F.array_min(F.transform("m", lambda m: F.struct(dist(m["v"], F.col("_v")).alias("d"), m["u"].alias("u"))))["u"]
        mine = open_.join(chosen, ["first_id", "part"]).select("_g", "_u", "_v", "n", "deg", "first_id", nearest.alias("part"), (F.size("m") > 1).alias("split"))
        mine = cut(mine, f"split{level}")
        sums = parted(mine, f"sums{level}").withColumnRenamed("loose", "still")
        # a part is named by its medoid, and one that could not be split stays as it is
        again = mine.join(sums, ["first_id", "part"]).withColumn("still", F.col("still") & F.col("split"))
        done = done.unionByName(again.where("not still").select("_g", "_u", "n", "deg", "first_id", F.col("part").alias("medoid_id"), F.lit(True).alias("loose")))
        open_ = again.where("still").select("_g", "_u", "_v", "n", "deg", "first_id", "part")
        sums = open_.select("first_id", "part").distinct().join(sums, ["first_id", "part"]).select("first_id", "part", "m", F.lit(True).alias("loose"))
    done = cut(done, "parts")
    order = F.row_number().over(Window.partitionBy("first_id", "medoid_id").orderBy(F.desc("deg"), "_u"))
    typical = done.withColumn("r", order).where(F.col("r") <= 3).groupBy("first_id", "medoid_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "_u"))), lambda e: e["_u"]).alias("typical"))
    sized = done.groupBy(F.col("_g").alias("group"), "first_id", "medoid_id", "loose").agg(F.sum("n").alias("size"))
    return sized.join(typical, ["first_id", "medoid_id"]).select("group", "first_id", "medoid_id", "size", "loose", "typical")
