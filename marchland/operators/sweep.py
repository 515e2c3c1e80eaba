"""Grids of parameters over one neighbour table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marchland.operators import centrality, evaluate
from marchland.operators.cluster import connect_flags, label, scores
from marchland.operators.neighbors import knn
from marchland.operators.prep import back_fill, dedup
from marchland.session import Cut


def sweep(df: DataFrame, ks: list[int], ratios: list[float], truth: str, uid: str = "id", dims: tuple[str, ...] = ("x", "y"), rule: str = "ceil") -> DataFrame:
    """(k, ratio, clusters, ari): every setting scored against the ``truth`` column.

    Neighbours are searched for once, for the largest k; a smaller k is a filter on the rank, and one k's scores serve all
    ratios.
    """
    cut = Cut(df.sparkSession)
    slim = df.select(F.col(uid).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in dims], truth)
    points = cut(dedup(slim, "id", dims).select(F.col("rep_id").alias("id"), *dims), "places")
    edges = cut(knn(points, max(ks), dims=list(dims)), "knn")
    rows = []
    for k in ks:
        mine = edges.where(F.col("rank") <= k)
        dcm = cut(scores(mine, points, list(dims)), f"dcm{k}")
        for ratio in ratios:
            labels = label(connect_flags(points, mine, centrality.flags(dcm, ratio, rule), list(dims)))
            full = back_fill(slim, labels, "cluster", "id", dims).join(slim.select("id", truth), "id")
            table = evaluate.contingency(full, truth, "cluster")
            clusters = labels.agg(F.max("cluster")).first()[0]
            score = evaluate.pair_metrics(table).select(F.lit(k).alias("k"), F.lit(float(ratio)).alias("ratio"), F.lit(clusters).cast("int").alias("clusters"), "ari")
            rows.append(cut(score, f"score{len(rows)}"))
    return reduce(DataFrame.unionByName, rows)


def best(results: DataFrame) -> DataFrame:
    """One row: the mean and greatest index, and the first setting (by k, then ratio) that reaches it."""
    key = F.struct("ari", (-F.col("k")).alias("k"), (-F.col("ratio")).alias("r"))
    return results.agg(F.avg("ari").alias("mean_ari"), F.max("ari").alias("max_ari"), F.max_by("k", key).alias("k"), F.max_by("ratio", key).alias("ratio"), F.max_by("clusters", key).alias("clusters"))
