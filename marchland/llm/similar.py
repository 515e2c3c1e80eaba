"""The k most similar vectors of every vector within its group.

Vectors are projected to a few dimensions by a stable projection (``llm.index``) and kept in a kd-tree (``operators.tree_knn``): the
tree's upper levels share the work out over tasks, its lower levels order each task's vectors. Neighbours in the projection
are verified in growing steps, nearest first, until the chi-square stopping test says that no unseen vector can, with the given
confidence, be nearer than the k found. Equal vectors are worked on once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marchland.llm.index import space_for
from marchland.operators.tree_knn import LEAF_ROWS, distinct_vectors, nearest_lists
from marchland.session import Cut


def most_similar(
    df: DataFrame,
    group: Column,
    uid: Column,
    vec: list[Column],
    k: int = 5,
    confidence: float = 0.95,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(group, id, neighbours): the k nearest other ids of each id of its group as an array of (d, i), by (squared distance
    rounded to 6 decimals, id).

    Rows with a null group, id or component, or a NaN one, take no part. Rows repeated under one id count once. A group with
    k records or fewer gives all of them. With no more than ``index.PROJECTED`` components the result is exact; else a true
    neighbour is missed with a probability of at most 1 - confidence. An empty table gives an empty result.
    """
    cut = Cut(df.sparkSession)
    usable = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c.cast("double")) for c in vec])
    # adding 0 turns -0.0 into 0.0
    array = F.array(*[(c.cast("double") + F.lit(0.0)) for c in vec])
    clean = df.where(usable)
    slim = clean.select(group.cast("long").alias("_g"), uid.cast("long").alias("_i"), array.alias("_v"))
    distinct = cut(distinct_vectors(slim, F.col("_g"), F.col("_i"), F.col("_v"), k + 2), "distinct")
    lists = nearest_lists(distinct, space_for(distinct, len(vec), confidence), k, leaf_rows, digits=6)
    several = distinct.where(F.size("_heads") > 1).select("_g", "_u", F.slice("_heads", 1, k + 1).alias("_heads"))
    # a vector that stands for one record needs no join
    heads = lists.join(several, ["_g", "_u"], "left").select("_g", F.explode(F.coalesce("_heads", F.array("_u"))).alias("_i"), "_near")
    heads = heads.select("_g", "_i", F.slice(F.filter("_near", lambda e: e["i"] != F.col("_i")), 1, k).alias("_near"))
    # of a vector with more copies than that, each further one has the lowest ids as its neighbours
    hot = distinct.where(F.size("_heads") == k + 2).select("_g", "_v", F.slice("_heads", 1, k).alias("_low"), F.element_at("_heads", k + 1).alias("_last"))
    tails = slim.join(hot, ["_g", "_v"]).where(F.col("_i") > F.col("_last"))
    tails = tails.groupBy("_g", "_i").agg(F.first("_low").alias("_low")).select("_g", "_i", F.transform("_low", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("i"))).alias("_near"))
    both = heads.unionByName(tails)
    return both.select(F.col("_g").alias("group"), F.col("_i").alias("id"), F.col("_near").alias("neighbours"))


def similar_pairs(lists: DataFrame) -> DataFrame:
    """(a_id, b_id), a_id < b_id: pairs of which at least one is among the other's neighbours."""
    pairs = lists.select("id", F.explode("neighbours.i").alias("other"))
    return pairs.select(F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")).distinct()
