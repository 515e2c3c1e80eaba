"""How unevenly the neighbours of a point lie around it: angle variance in the plane, simplex variance beyond."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marchland.operators.prep import rank_value


def angle(dx: Column, dy: Column) -> Column:
    """Direction in [0, 2π); 0 for no direction."""
    a = F.atan2(dy, dx)
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def neighbour_angles(edges: DataFrame, points: DataFrame, uid: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(id, nbr, angle) for the rows of a neighbour table."""
    a = points.select(F.col(uid).alias("id"), F.col(x).alias("ax"), F.col(y).alias("ay"))
    b = points.select(F.col(uid).alias("nbr"), F.col(x).alias("bx"), F.col(y).alias("by"))
    both = edges.select("id", "nbr").join(b, "nbr").join(a, "id")
    return both.select("id", "nbr", angle(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("angle"))


def dcm_2d(angles: DataFrame, ddof: int = 0) -> DataFrame:
    """(id, dcm): variance of the gaps between neighbouring directions, over its greatest possible value.

    0 for evenly spread neighbours, 1 for all in one direction. ``ddof`` 1 takes the sample variance over the same constant.
    A point's angles (as many as it has neighbours) meet in one array.
    """
    two_pi = 2 * math.pi
    each = angles.groupBy("id").agg(F.array_sort(F.collect_list("angle")).alias("a"))
    n = F.size("a")
    shifted = F.concat(F.slice("a", 2, F.greatest(n - 1, F.lit(0))), F.array(F.element_at("a", 1) + two_pi))
    squares = F.aggregate(F.zip_with(shifted, "a", lambda b, a: (b - a - two_pi / n) * (b - a - two_pi / n)), F.lit(0.0), lambda s, v: s + v)
    most = (n - 1) * (4 * math.pi * math.pi) / (n * n)
    return each.select("id", F.when(n > 1, squares / (n - ddof) / most).otherwise(F.lit(1.0)).alias("dcm"))


def sphere_facets(directions: np.ndarray) -> list[tuple[int, ...]]:
    """Facets of the hull of distinct unit vectors, each of exactly d points.

    Directions lie on the sphere, so all of them are corners: a set of d of them spans a facet if all others lie on one side.
    Found by walking from facet to facet over ridges; raises ValueError for degenerate sets.
    """
    n, d = directions.shape
    centre = directions - directions.mean(axis=0)
    if n <= d or np.linalg.matrix_rank(centre, tol=1e-9) < d:
        raise ValueError("the directions lie in a plane")
    tol = 1e-10

    def side(f: tuple[int, ...]) -> tuple[np.ndarray, float]:
        base = directions[list(f)]
        _, s, v = np.linalg.svd(base[1:] - base[0])
        if len(s) == d - 1 and s[-1] < 1e-12:
            raise ValueError("a facet is degenerate")
        normal = v[-1]
        return normal, float(normal @ base[0])

    def first() -> tuple[int, ...]:
        # wrap around from a lowest point: turn the plane until it rests on d points
        f = [int(np.lexsort(directions.T[::-1])[0])]
        normal = -np.eye(d)[0]
        while len(f) < d:
            span = [directions[i] - directions[f[0]] for i in f[1:]]
            basis = np.linalg.qr(np.array([*span, normal]).T)[0].T if span else np.array([normal])
            rel = directions - directions[f[0]]
            flat = rel - (rel @ basis.T) @ basis
            size = np.linalg.norm(flat, axis=1)
            turn = np.full(n, np.inf)
            free = np.ones(n, bool)
            free[f] = False
            ok = free & (size > 1e-12)
            turn[ok] = np.arctan2(-(rel[ok] @ normal), size[ok])
            j = int(turn.argmin())
            direction = flat[j] / size[j]
            t = turn[j]
            normal = np.cos(t) * normal + np.sin(t) * direction
            f.append(j)
        return tuple(sorted(f))

    start = first()
    seen, queue, out = {start}, [start], []
    while queue:
        f = queue.pop()
        normal, offset = side(f)
        heights = directions @ normal - offset
        if heights.max() > tol and heights.min() < -tol:
            raise ValueError("a set of points is no facet")
        if (np.abs(heights) <= tol).sum() > d:
            raise ValueError("more points than needed lie on a facet")
        if heights.max() > tol:
            normal, heights = -normal, -heights
        out.append(f)
        for drop in range(d):
            ridge = [i for k, i in enumerate(f) if k != drop]
            base = directions[ridge[0]]
            span = [directions[i] - base for i in ridge[1:]]
            basis = np.linalg.qr(np.array([*span, normal]).T)[0].T
            inward = directions[f[drop]] - base
            inward = inward - (inward @ basis.T) @ basis
            inward /= np.linalg.norm(inward)
            rel = directions - base
            turn = np.arctan2(-(rel @ normal), -(rel @ inward))
            turn[list(f)] = np.inf
            turn[turn < 0] += 2 * np.pi
            g = tuple(sorted([*ridge, int(turn.argmin())]))
            if g not in seen:
                seen.add(g)
                queue.append(g)
    return out


def facets_by_force(directions: np.ndarray) -> list[tuple[int, ...]]:
    """The same by trying every set of d points; for tests."""
    n, d = directions.shape
    out = []
    for f in combinations(range(n), d):
        base = directions[list(f)]
        _, s, v = np.linalg.svd(base[1:] - base[0])
        if s[-1] < 1e-12:
            continue
        h = directions @ v[-1] - v[-1] @ base[0]
        if h.max() <= 1e-10 or h.min() >= -1e-10:
            out.append(f)
    return out


def hull_dcm(offsets: np.ndarray, ddof: int = 0, fail_value: float = 1.0, norm: int = 1) -> float:
    """Variance of the facet simplices' volumes of the hull of the neighbours' directions; volumes are divided by gamma(d - norm)."""
    length = np.linalg.norm(offsets, axis=1)
    units = offsets[length > 0] / length[length > 0, None]
    units = np.unique(np.round(units, 12), axis=0)
    d = offsets.shape[1]
    try:
        volumes = []
        for f in sphere_facets(units):
            s = units[list(f)]
            volumes.append(math.sqrt(max(0.0, float(np.linalg.det(s @ s.T)))) / math.gamma(d - norm))
        return float(np.var(volumes, ddof=ddof))
    except (ValueError, np.linalg.LinAlgError):
        return fail_value


def dcm_hull(edges: DataFrame, points: DataFrame, dims: list[str], uid: str = "id", ddof: int = 0, fail_value: float = 1.0, norm: int = 1) -> DataFrame:
    """(id, dcm) in three dimensions or more. A point's neighbours (k rows) meet in one array; hulls run in Arrow batches."""
    a = points.select(F.col(uid).alias("id"), F.array(*[F.col(c).cast("double") for c in dims]).alias("a"))
    b = points.select(F.col(uid).alias("nbr"), F.array(*[F.col(c).cast("double") for c in dims]).alias("b"))
    off = edges.select("id", "nbr").join(b, "nbr").join(a, "id").select("id", F.struct("nbr", F.zip_with("b", "a", lambda u, v: u - v).alias("o")).alias("e"))
    each = off.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["o"]).alias("o"))

    @F.pandas_udf("double")
    def score(o: pd.Series) -> pd.Series:
        return o.map(lambda rows: hull_dcm(np.array([np.asarray(r, float) for r in rows]), ddof, fail_value, norm))

    return each.select("id", score("o").alias("dcm"))


def threshold_rank(n: int, ratio: float, rule: str = "ceil") -> int:
    """Position (1-based) of the threshold in ascending order; ``ratio`` is the share of internal points.

    ``ceil``: ⌈n·ratio⌉. ``next``: the one after it. ``round``: round(n·ratio). ``boundary``: the ⌊n·(1 - ratio)⌋-th largest.
    """
    if not 0 < ratio < 1:
        raise ValueError("the ratio lies between 0 and 1")
    up = math.ceil(n * ratio)
    at = {"ceil": up, "next": up + 1, "round": round(n * ratio), "boundary": n - int(n * (1 - ratio)) + 1}[rule]
    return min(max(1, at), n)


def flags(dcm: DataFrame, ratio: float, rule: str = "ceil") -> DataFrame:
    """(id, dcm, is_internal): internal points have less than the value at the threshold's position."""
    n = dcm.count()
    if not n:
        return dcm.withColumn("is_internal", F.lit(False))
    value = rank_value(dcm, "dcm", threshold_rank(n, ratio, rule))
    return dcm.withColumn("is_internal", F.col("dcm") < F.lit(value))


def local_dimensions(width: int, k: int) -> int:
    """Components kept of a neighbourhood: ⌊log2 k⌋, at least 2, at most all."""
    return max(2, min(width, int(math.log2(k)))) if k > 1 else min(2, width)


def facet_angles(units: np.ndarray) -> np.ndarray:
    """What each hull facet of unit vectors takes of the sphere: arcs in the plane, solid angles in space, simplex volumes beyond."""
    d = units.shape[1]
    if d == 2:
        turn = np.sort(np.arctan2(units[:, 1], units[:, 0]))
        gaps = np.diff(np.append(turn, turn[0] + 2 * np.pi))
        return np.minimum(gaps, 2 * np.pi - gaps)
    corners = np.array([units[list(f)] for f in sphere_facets(units)])
    if d == 3:
        a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
        triple = np.abs((a * np.cross(b, c)).sum(axis=1))
        dots = (a * b).sum(axis=1) + (b * c).sum(axis=1) + (c * a).sum(axis=1)
        half = np.arctan2(triple, 1 + dots)
        return 2 * half
    edges = corners[:, 1:] - corners[:, :1]
    return np.sqrt(np.maximum(0, np.linalg.det(edges @ edges.transpose(0, 2, 1)))) / math.gamma(d)


def local_dcm(cloud: np.ndarray, parts: int, fail_value: float = 1.0) -> float:
    """Sample variance of the facets' angles over the squared whole angle, times their number.

    ``cloud`` holds the point and then its neighbours; it is projected on its first ``parts`` principal components. What the
    facets lack of the whole angle is spread evenly over them; each repeated direction counts as parts - 1 facets of none.
    """
    if cloud.shape[1] > parts:
        centred = cloud - cloud.mean(axis=0)
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        cloud = centred @ axes[:parts].T
    off = cloud[1:] - cloud[0]
    length = np.linalg.norm(off, axis=1)
    directions = np.round(off[length > 0] / length[length > 0, None], 12)
    units = np.unique(directions, axis=0)
    try:
        if len(units) < 2:
            return fail_value
        angles = facet_angles(units)
    except (ValueError, np.linalg.LinAlgError):
        return fail_value
    whole = 2 * math.pi ** (parts / 2) / math.gamma(parts / 2)
    if parts > 2:
        angles = angles + (whole - angles.sum()) / len(angles)
    angles = np.append(angles, np.zeros((len(off) - len(units)) * (parts - 1)))
    return float(angles.var(ddof=1) * len(angles) / whole**2) if len(angles) > 1 else fail_value


def dcm_local(edges: DataFrame, points: DataFrame, vec: str, parts: int, uid: str = "id", fail_value: float = 1.0) -> DataFrame:
    """(id, dcm) of points in an array column, each in the principal plane or space of its own neighbourhood."""
    own = points.select(F.col(uid).alias("id"), F.col(vec).alias("a"))
    other = points.select(F.col(uid).alias("nbr"), F.col(vec).alias("b"))
    each = edges.select("id", "nbr", "rank").join(other, "nbr").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda e: e["b"]).alias("near")).join(own, "id")

    @F.pandas_udf("double")
    def score(a: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series([local_dcm(np.array([np.asarray(p, float), *[np.asarray(q, float) for q in rest]]), parts, fail_value) for p, rest in zip(a, near)])

    return each.select("id", score("a", "near").alias("dcm"))
