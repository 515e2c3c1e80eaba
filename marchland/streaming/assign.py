"""Structured Streaming: new points are given to the clusters of an existing result, and batches of points are checked in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marchland.operators.neighbors import nearest_in


def read_point_files(spark: SparkSession, folder: str, schema: str = "id long, x double, y double, ts timestamp", files_per_batch: int = 10) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def assign_stream(points: DataFrame, internal: DataFrame, out: str, checkpoint: str, within: float | None = None) -> StreamingQuery:
    """Writes (id, x, y, cluster, distance) of each micro-batch: the cluster of the nearest internal point (id, x, y, cluster).

    Points farther than ``within`` from all of them get cluster 0. Points delivered again within a batch count once. A batch
    that runs again after a failure replaces its own files: each batch has a folder of its own.
    """

    def batch(df: DataFrame, number: int) -> None:
        new = df.select("id", "x", "y").dropDuplicates(["id"])
        # ids of both sides may clash without being the same point
        base = internal.select((-F.col("id") - 1).alias("id"), "x", "y", "cluster")
        near = nearest_in(new, base, 1).join(base.select(F.col("id").alias("nbr"), "cluster"), "nbr")
        found = new.join(near.select("id", "cluster", F.sqrt("d2").alias("distance")), "id", "left")
        if within is not None:
            found = found.withColumn("cluster", F.when(F.col("distance") <= within, F.col("cluster")).otherwise(F.lit(0)))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(points: DataFrame, cell: float, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, cx, cy, n) of points by event time and grid cell; rows later than ``late`` are left out by the watermark."""
    placed = points.withWatermark("ts", late).withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    return placed.groupBy(F.window("ts", window), "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
