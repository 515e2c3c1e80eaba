"""Three noise detectors over a neighbour table (id, rank, nbr, d2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marchland.operators.neighbors import reverse_count


def _scaled(df: DataFrame, col: str) -> DataFrame:
    """The column min-max scaled over all rows; the extremes come from one aggregate row."""
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if row["lo"] is None or row["lo"] == row["hi"]:
        return df.withColumn("score", F.lit(0.0))
    return df.withColumn("score", (F.col(col) - F.lit(row["lo"])) / (F.lit(float(row["hi"])) - F.lit(float(row["lo"]))))


def outlier_factor(edges: DataFrame) -> DataFrame:
    """(id, lof): the neighbours' mean local reachability density over one's own.

    Reachability is max(the neighbour's k-distance, the distance). A point among k copies of itself has no finite density: its
    factor is 1.
    """
    dist = F.sqrt("d2")
    e = edges.select("id", "nbr", dist.alias("d"))
    kdist = e.groupBy("id").agg(F.max("d").alias("kd"))
    lrd = e.join(kdist.select(F.col("id").alias("nbr"), "kd"), "nbr").groupBy("id").agg((F.count(F.lit(1)) / F.sum(F.greatest("kd", "d"))).alias("lrd"))
    of = e.join(lrd.select(F.col("id").alias("nbr"), F.col("lrd").alias("n_lrd")), "nbr").groupBy("id").agg(F.avg("n_lrd").alias("m"))
    value = F.coalesce(F.nanvl(F.col("m") / F.col("lrd"), F.lit(1.0)), F.lit(1.0))
    return of.join(lrd, "id").select("id", value.alias("lof"))


def lof(edges: DataFrame, threshold: float) -> DataFrame:
    """(id, lof, score, is_noise): noise where the scaled factor is above the threshold."""
    return _scaled(outlier_factor(edges), "lof").withColumn("is_noise", F.col("score") > threshold)


def rknn(edges: DataFrame, points: DataFrame, threshold: float, uid: str = "id") -> DataFrame:
    """(id, n, score, is_noise): noise where few others have the point among their neighbours."""
    return _scaled(reverse_count(edges, points, uid), "n").withColumn("is_noise", F.col("score") < threshold)


def idm(edges: DataFrame, threshold: float) -> DataFrame:
    """(id, idm, is_noise): noise where 1 / the summed distance to the neighbours is below the threshold; copies of a point are none."""
    total = F.sum(F.sqrt("d2"))
    return edges.groupBy("id").agg(F.when(total > 0, 1 / total).alias("idm")).withColumn("is_noise", F.coalesce(F.col("idm") < threshold, F.lit(False)))
