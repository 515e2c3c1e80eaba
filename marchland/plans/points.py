"""Point sets made from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marchland.plans.load import table


def emb2d(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y, label): the first two components of the embeddings."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"), "label")


def emb3d(spark: SparkSession, d: str) -> DataFrame:
    z = F.element_at("embedding", 3).cast("double").alias("z")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"), z, "label")


def emb64(spark: SparkSession, d: str) -> DataFrame:
    """(id, vec, label)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"), "label")


def cust2d(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y): balance / 100 and total order value / 10,000 of each customer."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("t"))
    c = table(spark, d, "customer").join(orders, "c_custkey", "left")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal").cast("double") / 100).alias("x"), (F.coalesce("t", F.lit(0)) / 1000000).alias("y"))


def part2d(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y): size and price in tens; many parts share a place."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.floor(F.col("p_retailprice").cast("double") / 10).cast("double").alias("y"))


def bits64(spark: SparkSession, d: str) -> DataFrame:
    """(id, words): signs of the 64 components as two 32-bit words (each within a bigint)."""
    words = [sum((F.when(F.element_at("embedding", w * 32 + b + 1) > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(1, 32)), F.when(F.element_at("embedding", w * 32 + 1) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")) for w in (0, 1)]
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(*words).alias("words"))


def event_pts(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y): seconds since the first event / 1,000 and the value."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), (F.unix_timestamp("ts") / 1000).alias("x"), F.col("value").cast("double").alias("y"))


EMB2D = "(SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"
EMB64 = "(SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec, label FROM embeddings)"
CUST2D = """(SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) / 100 AS x, CAST(coalesce(t, 0) AS DOUBLE) / 1000000 AS y FROM customer
  LEFT JOIN (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
PART2D = "(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(floor(CAST(p_retailprice AS DOUBLE) / 10) AS DOUBLE) AS y FROM part)"
BITS64 = (
    "(SELECT vec_id AS id, "
    + ", ".join("(" + " + ".join(f"CASE WHEN embedding[{w * 32 + b + 1}] > 0 THEN CAST({1 << b} AS BIGINT) ELSE 0 END" for b in range(32)) + f") AS w{w}" for w in (0, 1))
    + " FROM embeddings)"
)
