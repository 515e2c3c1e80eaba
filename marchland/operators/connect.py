"""Reach, anchors, overlapping reach balls and what they connect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marchland.operators.neighbors import nearest_in
from marchland.session import Cut


def opposite(edges: DataFrame, flags: DataFrame, points: DataFrame, dims: list[str]) -> DataFrame:
    """(id, is_internal, nbr, d2): each point's nearest point of the other kind, by (distance, id).

    The first one in the neighbour list is the nearest of all, as the list holds every nearer point; only points whose whole
    list is of their own kind are searched for in the other kind's points. Without the other kind there is no row.
    """
    cut = Cut(points.sparkSession)
    kind = flags.select(F.col("id").alias("nbr"), F.col("is_internal").alias("other"))
    listed = edges.select("id", "nbr", "d2").join(kind, "nbr").join(flags.select("id", "is_internal"), "id").where(F.col("is_internal") != F.col("other"))
    first = cut(listed.groupBy("id", "is_internal").agg(F.min(F.struct("d2", "nbr")).alias("m")).select("id", "is_internal", "m.nbr", "m.d2"), "listed")
    open_ = cut(points.select("id", *dims).join(flags.select("id", "is_internal"), "id").join(first.select("id"), "id", "left_anti"), "open")
    both = first
    for internal in [r[0] for r in open_.select("is_internal").distinct().collect()]:
        rest = open_.where(F.col("is_internal") == internal)
        base = points.join(flags.where(F.col("is_internal") != internal).select("id"), "id", "left_semi")
        both = both.unionByName(nearest_in(rest, base, 1, dims=dims).select("id", F.lit(internal).alias("is_internal"), "nbr", "d2"))
    return both


def reach(near: DataFrame) -> DataFrame:
    """(id, reach) of the internal points: the distance to the nearest boundary point."""
    return near.where("is_internal").select("id", F.sqrt("d2").alias("reach"))


def anchors(near: DataFrame) -> DataFrame:
    """(id, anchor_id) of the boundary points: the nearest internal point."""
    return near.where("not is_internal").select("id", F.col("nbr").alias("anchor_id"))


def overlap_edges(balls: DataFrame, dims: list[str]) -> DataFrame:
    """(src, dst), src < dst: balls (id, *dims, reach) whose distance is at most the sum of their reaches.

    One equi-join over cells of several sizes: a ball's level is the power of two next above its reach. As the larger partner
    it looks into the cells around it at its own level, as the smaller one it lies in one cell of every level from its own
    up; two overlapping balls are at most two cell sides apart at the larger one's level. Works in any (small) dimension.
    """
    # without any reach a ball only meets those at its own place: the lowest level of all
    spark = balls.sparkSession
    level = F.when(F.col("reach") > 0, F.ceil(F.log2("reach")).cast("int")).otherwise(F.lit(-40))
    leveled = Cut(spark)(balls.select("id", *dims, "reach").withColumn("lvl", F.greatest(level, F.lit(-40))), "balls")
    levels = sorted(r["lvl"] for r in leveled.select("lvl").distinct().collect())  # powers of two: at most about 2000 exist
    if not levels:
        return balls.select(F.col("id").alias("src"), F.col("id").alias("dst")).where(F.lit(False))
    side = 2 * F.pow(F.lit(2.0), F.col("b"))
    cell = F.array(*[F.floor(F.col(c) / side) for c in dims])
    around = [[]]
    for _ in dims:
        around = [a + [i] for a in around for i in (-1, 0, 1)]
    steps = F.array(*[F.array(*[F.lit(i).cast("long") for i in a]) for a in around])
    big = leveled.withColumn("b", F.col("lvl")).withColumn("cell", cell).withColumn("o", F.explode(steps)).withColumn("cell", F.zip_with("cell", "o", lambda c, o: c + o))
    big = big.select(F.col("id").alias("big"), *[F.col(c).alias(f"b_{c}") for c in dims], F.col("reach").alias("b_reach"), "b", "cell")
    up = F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("lvl")))
    small = leveled.withColumn("b", up).withColumn("cell", cell).select(F.col("id").alias("small"), *dims, "reach", "lvl", "b", "cell")
    d2 = sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in dims[1:]), (F.col(dims[0]) - F.col(f"b_{dims[0]}")) * (F.col(dims[0]) - F.col(f"b_{dims[0]}")))
    pairs = big.join(small, ["b", "cell"]).where((F.col("lvl") < F.col("b")) | (F.col("small") < F.col("big"))).where(F.sqrt(d2) <= F.col("reach") + F.col("b_reach"))
    return pairs.select(F.least("big", "small").alias("src"), F.greatest("big", "small").alias("dst")).where("src <> dst").distinct()


def single_pass(balls: DataFrame, edges: DataFrame, order: str = "id") -> DataFrame:
    """(id, component): the order-dependent merge, for comparison with results made that way.

    Points are visited by id (or by reach, falling). Only a point without a label spreads one: it takes the label of the
    first labelled neighbour by visiting order, merges that of the others into it, and labels those without. The visiting
    order makes this one task's work; it holds the balls and their overlaps, so use it for small tables only.
    """
    rows = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    lists = balls.select("id", "reach").join(rows.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs")), "id", "left")

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(parts))
        df = df.sort_values(["id"] if order == "id" else ["reach", "id"], ascending=True if order == "id" else [False, True])
        place = {i: p for p, i in enumerate(df["id"])}
        label: dict[int, int] = {}
        members: dict[int, list[int]] = {}
        for i, nbrs in zip(df["id"], df["nbrs"]):
            if i in label:
                continue
            near = [] if nbrs is None else sorted(nbrs, key=place.__getitem__)
            known = [label[j] for j in near if j in label]
            mine = known[0] if known else i
            home = members.setdefault(mine, [])
            for old in set(known) - {mine}:
                for j in members.pop(old):
                    label[j] = mine
                    home.append(j)
            for j in [i, *near]:
                if j not in label:
                    label[j] = mine
                    home.append(j)
        if label:
            low = {m: min(js) for m, js in members.items()}
            yield pd.DataFrame({"id": np.array(list(label), np.int64), "component": np.array([low[m] for m in label.values()], np.int64)})

    return lists.coalesce(1).mapInPandas(visit, "id long, component long")
