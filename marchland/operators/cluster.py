"""Clustering by boundaries: points unevenly surrounded are boundary, the others connect where their reach balls overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marchland.operators import centrality, connect
from marchland.operators.components import components
from marchland.operators.neighbors import knn
from marchland.operators.prep import back_fill, dedup, dense_numbers, min_max, principal_components
from marchland.session import Cut


@dataclass(frozen=True)
class Stages:
    """The tables of one run; ``points`` are the distinct places."""

    points: DataFrame
    edges: DataFrame
    flags: DataFrame
    near: DataFrame
    balls: DataFrame
    overlaps: DataFrame
    components: DataFrame


def scores(edges: DataFrame, points: DataFrame, dims: list[str], ddof: int = 0) -> DataFrame:
    """(id, dcm) by the rule for the number of dimensions."""
    if len(dims) == 2:
        return centrality.dcm_2d(centrality.neighbour_angles(edges, points, x=dims[0], y=dims[1]), ddof)
    return centrality.dcm_hull(edges, points, dims, ddof=ddof)


def connect_flags(points: DataFrame, edges: DataFrame, flagged: DataFrame, dims: list[str], merge: str = "components", order: str = "id") -> Stages:
    """From internal and boundary points to the components of the internal ones."""
    cut = Cut(points.sparkSession)
    near = cut(connect.opposite(edges, flagged, points, dims), "near")
    balls = points.select("id", *dims).join(connect.reach(near), "id")
    overlaps = cut(connect.overlap_edges(balls, dims), "overlaps")
    if merge == "components":
        found = components(overlaps)
        comp = connect.reach(near).select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    else:
        comp = connect.single_pass(balls, overlaps, order)
    return Stages(points, edges, flagged, near, balls, overlaps, cut(comp, "components"))


def run(df: DataFrame, k: int, ratio: float, uid: str = "id", dims: tuple[str, ...] = ("x", "y"), rule: str = "ceil", scale: bool = False, merge: str = "components", order: str = "id", ddof: int = 0) -> Stages:
    """All stages; see ``cluster``."""
    if k <= 0 or not 0 < ratio < 1:
        raise ValueError("k must be above 0 and the ratio between 0 and 1")
    if len(dims) < 2:
        raise ValueError("points need two dimensions or more")
    cut = Cut(df.sparkSession)
    slim = df.select(F.col(uid).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in dims])
    for c in dims:
        slim = slim.where(F.col(c).isNotNull() & ~F.isnan(c))
    if scale:
        slim = min_max(slim, list(dims))
    points = cut(dedup(slim, "id", dims).select(F.col("rep_id").alias("id"), *dims), "places")
    if points.count() <= k:
        raise ValueError("there must be more than k distinct points")
    edges = cut(knn(points, k, dims=list(dims)), "knn")
    flagged = centrality.flags(cut(scores(edges, points, list(dims), ddof), "dcm"), ratio, rule)
    return connect_flags(points, edges, flagged, list(dims), merge, order)


def label(stages: Stages) -> DataFrame:
    """(id, cluster): internal points by component, boundary points by anchor; numbered from 1 by lowest id in the cluster."""
    bound = connect.anchors(stages.near).join(stages.components.select(F.col("id").alias("anchor_id"), "component"), "anchor_id").select("id", "component")
    whole = stages.components.select("id", "component").unionByName(bound)
    firsts = whole.groupBy("component").agg(F.min("id").alias("first_id"))
    numbers = dense_numbers(firsts, "first_id", "cluster")
    return whole.join(numbers.select("component", "cluster"), "component").select("id", "cluster")


def cluster(df: DataFrame, k: int, ratio: float, uid: str = "id", dims: tuple[str, ...] = ("x", "y"), **options) -> DataFrame:
    """(id, cluster) for every usable point.

    Points at one place are one point while clustering and share its label. If all points are scored alike, none is
    internal and the result is empty. Options: ``rule`` (see ``threshold_rank``), ``scale`` (min-max first), ``merge``
    (``components`` or the order-dependent ``single_pass``), ``order``, ``ddof``.
    """
    labels = label(run(df, k, ratio, uid, dims, **options))
    slim = df.select(F.col(uid).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in dims])
    if options.get("scale"):
        slim = min_max(slim, list(dims))
    return back_fill(slim, labels, "cluster", "id", dims).where(F.col("cluster").isNotNull())


def cluster_embedded(df: DataFrame, k: int, ratio: float, vec: str, components: int | float = 2, uid: str = "id", **options) -> DataFrame:
    """(id, cluster) of long vectors by their first principal ``components`` (below 1: the share of variance to keep)."""
    pcs, axes, _ = principal_components(df, vec, components, uid)
    names = [f"c{i}" for i in range(max(2, axes.shape[1]))]
    flat = pcs.select("id", *[F.get("pc", i).alias(n) if i < axes.shape[1] else F.lit(0.0).alias(n) for i, n in enumerate(names)])
    return cluster(flat, k, ratio, dims=tuple(names), **options)


def cluster_without_noise(df: DataFrame, noise: DataFrame, k: int, ratio: float, uid: str = "id", dims: tuple[str, ...] = ("x", "y"), **options) -> DataFrame:
    """(id, cluster): points listed in ``noise`` (id) get 0, the others are clustered without them."""
    kept = df.join(noise.select(F.col("id").alias(uid)), uid, "left_anti")
    found = cluster(kept, k, ratio, uid, dims, **options)
    return df.select(F.col(uid).alias("id")).join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(0)).alias("cluster"))
