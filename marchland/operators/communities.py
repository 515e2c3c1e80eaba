"""Communities of a weighted graph by local moves that raise the modularity, level by level, on whole tables.

In a round every second node (by a hash that changes with the round) moves to the neighbouring community with the greatest gain;
that only some move at once keeps neighbours from swapping places for ever. When no round helps any more, communities become
the nodes of a smaller graph. A round is two aggregates over the edges; no node's neighbours must fit into one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marchland.session import Cut


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of labels (id, community) over edges (src, dst, weight), each edge listed once; 0 without edges."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    per = both.join(a, "src").join(b, "dst").groupBy("ca").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inner"))
    sums = per.agg(F.sum("total").alias("m"), F.sum("inner").alias("i"), F.sum(F.col("total") * F.col("total")).alias("s"))
    return sums.select(F.coalesce(F.col("i") / F.col("m") - resolution * F.col("s") / (F.col("m") * F.col("m")), F.lit(0.0)).alias("modularity"))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 4, least: float = 1e-4) -> DataFrame:
    """(id, community) of all nodes of the edges (src, dst, weight); a community is named by its lowest id.

    Edges are undirected; repeated ones add up, loops and edges without weight or an end are left out. A higher ``resolution``
    gives smaller communities. A level ends after ``rounds`` rounds, or when two in a row move less than ``least`` of its nodes.
    """
    cut = Cut(edges.sparkSession)
    clean = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("weight") > 0) & (F.col("src") != F.col("dst")))
    one = clean.groupBy(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
    # inside a node of a later level: twice the weight of its own edges
    graph = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "graph0")
    whole = graph.agg(F.sum("w")).first()[0]
    named = graph.select(F.col("a").alias("id")).distinct().withColumn("node", F.col("id"))
    if not whole:
        return named.select("id", F.col("node").alias("community"))
    named = cut(named, "named")
    for level in range(levels):
        strength = graph.groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("k"))
        state = cut(strength.withColumn("c", F.col("n")), f"state{level}")
        nodes = state.count()
        quiet = 0
        for turn in range(rounds):
            sums = state.groupBy("c").agg(F.sum("k").alias("total"))
            reach = graph.where("a <> b").join(state.select(F.col("n").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
            own = state.select(F.col("n").alias("a"), "k", F.col("c").alias("mine"))
            moves = own.join(reach, "a").join(sums, "c")
            # what a node gains by being in a community, its own weight there left out
            gain = F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / F.lit(whole)
            best = moves.withColumn("g", gain).groupBy("a").agg(F.max(F.struct(F.col("g"), (-F.col("c")).alias("c"))).alias("best"), F.max(F.when(F.col("c") == F.col("mine"), F.col("g"))).alias("stay"))
            # a node with no neighbour in its own community stays there only by itself, or against the others' weight
            alone = F.when(F.col("total") > F.col("k"), -resolution * F.col("k") * (F.col("total") - F.col("k")) / F.lit(whole)).otherwise(0.0)
            placed = state.join(sums, "c").join(best.withColumnRenamed("a", "n"), "n", "left")
            better = F.col("best.g") > F.coalesce("stay", alone) + 1e-12
            turns = F.pmod(F.xxhash64(F.lit(level), F.lit(turn), F.col("n")), F.lit(2)) == 0
            new = placed.select("n", "k", F.when(F.coalesce(better, F.lit(False)) & turns, -F.col("best.c")).otherwise(F.col("c")).alias("c"), F.col("c").alias("was"))
            new = cut(new, f"round{level}_{turn}")
            moved = new.where("c <> was").count()
            state = new.drop("was")
            quiet = quiet + 1 if moved <= least * nodes else 0
            if quiet == 2:
                break
        fresh = state.groupBy("c").agg(F.min("n").alias("name"))
        to = cut(state.join(fresh, "c").select("n", "name"), f"to{level}")
        named = cut(named.join(to.select(F.col("n").alias("node"), "name"), "node").select("id", F.col("name").alias("node")), f"named{level}")
        smaller = graph.join(to.select(F.col("n").alias("a"), F.col("name").alias("na")), "a").join(to.select(F.col("n").alias("b"), F.col("name").alias("nb")), "b")
        graph = cut(smaller.groupBy(F.col("na").alias("a"), F.col("nb").alias("b")).agg(F.sum("w").alias("w")), f"graph{level + 1}")
        if to.select("name").distinct().count() == nodes:
            break
    lowest = named.groupBy("node").agg(F.min("id").alias("community"))
    return named.join(lowest, "node").select("id", "community")
