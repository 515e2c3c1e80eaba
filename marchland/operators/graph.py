"""The fuzzy neighbour graph: smoothed distances, memberships, and their union or intersection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bandwidths are at least this share of the mean distance, so that crowded points keep some reach.
LEAST_SHARE = 1e-3


def bandwidths(edges: DataFrame, k: int, local: float = 1.0, rounds: int = 64) -> DataFrame:
    """(id, rho, sigma): distance to the nearest neighbour not at the same place, and the bandwidth whose memberships sum to log2 k.

    A point's k distances meet in one array; the bisection runs on all points of an Arrow batch at once.
    """
    each = edges.groupBy("id").agg(F.array_sort(F.collect_list(F.sqrt("d2"))).alias("d"))

    @F.pandas_udf("struct<rho: double, sigma: double>")
    def solve(lists: pd.Series) -> pd.DataFrame:
        width = max(map(len, lists), default=0)
        d = np.full((len(lists), width), np.nan)
        for i, v in enumerate(lists):
            d[i, : len(v)] = v
        positive = np.where(d > 0, d, np.nan)
        some = ~np.isnan(positive).all(axis=1)
        rho = np.zeros(len(d))
        ordered = np.sort(positive, axis=1)
        whole, part = int(local), local - int(local)
        if whole >= 1:
            first = ordered[:, min(whole, width) - 1]
            rho = np.where(some, np.where(np.isnan(first), np.nanmax(np.where(some[:, None], positive, 0), axis=1), first), 0)
            if part > 0 and whole < width:
                step = np.nan_to_num(ordered[:, whole] - first)
                rho = rho + part * step
        else:
            rho = np.where(some, part * np.nan_to_num(ordered[:, 0]), 0)
        target = np.log2(k)
        lo, hi, mid = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
        beyond = np.maximum(0, d - rho[:, None])
        for _ in range(rounds):
            total = np.nansum(np.exp(-beyond / mid[:, None]), axis=1)
            high = total > target
            hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
            mid = np.where(np.isinf(hi), mid * 2, (lo + hi) / 2)
            mid = np.maximum(mid, 1e-300)
        mean = np.nanmean(d, axis=1) if width else np.zeros(len(d))
        return pd.DataFrame({"rho": rho, "sigma": np.maximum(np.minimum(mid, 1e300), LEAST_SHARE * mean)})

    return each.select("id", solve("d").alias("s")).select("id", "s.rho", "s.sigma")


def memberships(edges: DataFrame, widths: DataFrame) -> DataFrame:
    """(src, dst, w): exp(-(d - rho) / sigma), 1 up to rho."""
    over = F.greatest(F.lit(0.0), F.sqrt("d2") - F.col("rho"))
    w = F.when((over <= 0) | (F.col("sigma") <= 0), F.lit(1.0)).otherwise(F.exp(-over / F.col("sigma")))
    return edges.join(widths, "id").select(F.col("id").alias("src"), F.col("nbr").alias("dst"), w.alias("w"))


def fuzzy_union(directed: DataFrame, mix: float = 1.0) -> DataFrame:
    """(src, dst, w), both directions: ``mix`` of the union a + b - ab and the rest of the intersection ab."""
    back = directed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("b"))
    both = directed.withColumnRenamed("w", "a").join(back, ["src", "dst"], "full").na.fill(0.0, ["a", "b"])
    w = mix * (F.col("a") + F.col("b") - F.col("a") * F.col("b")) + (1 - mix) * F.col("a") * F.col("b")
    return both.select("src", "dst", w.alias("w")).where("w > 0")


def by_category(graph: DataFrame, labels: DataFrame, far: float = 5.0, unknown: float = 1.0) -> DataFrame:
    """Edges between different labels (id, label) weakened by exp(-far), those to unknown (NULL) ones by exp(-unknown)."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    j = graph.join(a, "src").join(b, "dst")
    factor = F.when(F.col("la").isNull() | F.col("lb").isNull(), F.exp(F.lit(-unknown))).when(F.col("la") != F.col("lb"), F.exp(F.lit(-far))).otherwise(F.lit(1.0))
    return j.select("src", "dst", (F.col("w") * factor).alias("w"))


def fuzzy_graph(edges: DataFrame, k: int, mix: float = 1.0) -> DataFrame:
    """From a neighbour table (id, rank, nbr, d2) to the symmetric weighted graph."""
    return fuzzy_union(memberships(edges, bandwidths(edges, k)), mix)


def epochs_per_sample(graph: DataFrame, epochs: int) -> DataFrame:
    """Adds ``every``: how many epochs pass between two uses of an edge; edges too weak to be used have none."""
    top = graph.agg(F.max("w")).first()[0] or 1.0
    uses = F.lit(float(epochs)) * F.col("w") / F.lit(top)
    return graph.withColumn("every", F.when(uses >= 1, F.lit(float(epochs)) / uses))


def fit_curve(spread: float = 1.0, min_dist: float = 0.1) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^(2b)), least-squares fitted to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    theta = np.array([0.0, 0.0])  # logarithms of a and b
    damp = 1e-2

    def off(t):
        return 1 / (1 + np.exp(t[0]) * d ** (2 * np.exp(t[1]))) - y

    for _ in range(200):
        f = off(theta)
        jac = np.stack([(off(theta + h) - f) / 1e-6 for h in np.eye(2) * 1e-6], axis=1)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(2), -jac.T @ f)
        if (off(theta + step) ** 2).sum() < (f**2).sum():
            theta, damp = theta + step, damp / 3
        else:
            damp *= 3
        if np.abs(step).max() < 1e-12:
            break
    return float(np.exp(theta[0])), float(np.exp(theta[1]))


def intersect_graphs(a: DataFrame, b: DataFrame, mix: float = 0.5) -> DataFrame:
    """(src, dst, w) of the edges of either graph (src, dst, w): a · b^(mix / (1 - mix)), or a^((1 - mix) / mix) · b from 0.5 on.

    An edge that one graph lacks counts there as half its least weight, but at least 1e-8.
    """
    if not 0 < mix < 1:
        raise ValueError("the mix lies between 0 and 1")
    least = lambda g, n: g.agg(F.greatest(F.min("w") / 2, F.lit(1e-8)).alias(n))
    both = a.select("src", "dst", F.col("w").alias("a")).join(b.select("src", "dst", F.col("w").alias("b")), ["src", "dst"], "full")
    both = both.crossJoin(F.broadcast(least(a, "la"))).crossJoin(F.broadcast(least(b, "lb")))  # one row each
    x, y = F.coalesce("a", "la", F.lit(1e-8)), F.coalesce("b", "lb", F.lit(1e-8))
    w = x * F.pow(y, F.lit(mix / (1 - mix))) if mix < 0.5 else F.pow(x, F.lit((1 - mix) / mix)) * y
    return both.select("src", "dst", w.alias("w"))


def reset_local_connectivity(g: DataFrame) -> DataFrame:
    """(src, dst, w): each node's weights over its greatest one, then the fuzzy union with the reversed graph."""
    top = g.groupBy("src").agg(F.max("w").alias("m"))
    scaled = g.join(top, "src").select("src", "dst", (F.col("w") / F.col("m")).alias("w"))
    back = scaled.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    both = scaled.join(back, ["src", "dst"], "full").na.fill(0.0, ["w", "v"])
    return both.select("src", "dst", (F.col("w") + F.col("v") - F.col("w") * F.col("v")).alias("w"))
