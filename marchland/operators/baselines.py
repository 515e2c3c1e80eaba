"""Other clusterers and classifiers to compare with."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marchland.operators.components import components
from marchland.operators.dense import cell_rest, point_degrees
from marchland.operators.neighbors import nearest_in
from marchland.operators.prep import dense_numbers
from marchland.session import Cut


def k_means(df: DataFrame, k: int, vec: str, uid: str = "id", seed: int = 1, mode: str = "k-means||", rounds: int = 20) -> DataFrame:
    """(id, cluster), clusters 0-based."""
    ready = df.select(F.col(uid).alias("id"), array_to_vector(F.transform(vec, lambda v: v.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, initMode=mode, maxIter=rounds).fit(ready)
    return model.transform(ready).select("id", F.col("prediction").alias("cluster"))


def k_means_sweep(df: DataFrame, ks: list[int], vec: str, uid: str = "id", seed: int = 1) -> DataFrame:
    """(k, id, cluster) for several k."""
    return reduce(DataFrame.unionByName, [k_means(df, k, vec, uid, seed).select(F.lit(k).alias("k"), "id", "cluster") for k in ks])


def dbscan(df: DataFrame, radius: float, least: int, uid: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(id, cluster, is_core): density clusters numbered from 1 by their lowest core id; noise has 0.

    A core point has ``least`` points within the radius, itself included. A border point joins its nearest core point, by
    (distance, id). Points are counted and linked by cells, so pairs are never listed; a place of many points is one node. Rows
    with a null or NaN coordinate are noise.
    """
    cut = Cut(df.sparkSession)
    points = cut(df.select(F.col(uid).cast("long").alias("id"), (F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y")), "points")
    usable = points.where(F.col("id").isNotNull() & ~F.isnan(F.coalesce("x", F.lit(float("nan")))) & ~F.isnan(F.coalesce("y", F.lit(float("nan")))))
    places = usable.groupBy("x", "y").agg(F.min("id").alias("_u"), F.count(F.lit(1)).alias("n"))
    places = cut(places.select(F.lit(0).cast("long").alias("_g"), F.array("x", "y").alias("_v"), "x", "y", "_u", "n"), "places")
    degrees = point_degrees(places, radius, None)
    marked = cut(places.join(degrees, "_u").withColumn("is_core", F.col("links") + F.col("n") >= least), "marked")
    core = marked.where("is_core").withColumn("_c", F.col("_u"))
    found = components(cell_rest(core, radius, digits=None), "v", "u").select(F.col("id").alias("_u"), "component")
    comp = cut(core.select("_u").join(found, "_u", "left").select("_u", F.coalesce("component", "_u").alias("component")), "components")
    numbered = comp.join(dense_numbers(comp.select("component").distinct(), "component", "cluster"), "component").select("_u", "cluster")
    near = nearest_in(marked.where("not is_core").select(F.col("_u").alias("id"), "x", "y"), core.select(F.col("_u").alias("id"), "x", "y"), 1).where(F.col("d2") <= radius * radius)
    border = near.join(numbered.withColumnRenamed("_u", "nbr"), "nbr").select(F.col("id").alias("_u"), "cluster")
    whole = marked.join(numbered.unionByName(border), "_u", "left").select("x", "y", F.coalesce("cluster", F.lit(0)).alias("cluster"), "is_core")
    return points.join(whole, ["x", "y"], "left").select("id", F.coalesce("cluster", F.lit(0)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def assign_by_vote(new: DataFrame, labelled: DataFrame, label: str, k: int = 5, uid: str = "id", dims: list[str] | str = ("x", "y")) -> DataFrame:
    """(id, label): the most frequent label among the k nearest labelled points; ties take the label of the nearest."""
    near = nearest_in(new, labelled, k, uid, dims).join(labelled.select(F.col(uid).alias("nbr"), label), "nbr")
    votes = near.groupBy("id", label).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return votes.groupBy("id").agg(F.max_by(label, F.struct("n", -F.col("first"))).alias(label))


def perceptron(train: DataFrame, test: DataFrame, label: str, vec: str, hidden: tuple[int, ...] = (100, 50, 25), rounds: int = 75, uid: str = "id", seed: int = 1) -> DataFrame:
    """(id, prediction) of a multilayer perceptron over standardised features; labels are 0-based integers."""
    ready = lambda t, *c: t.select(*c, array_to_vector(F.transform(vec, lambda v: v.cast("double"))).alias("raw"))
    a = ready(train, F.col(label).cast("double").alias("label"))
    shape = a.agg(F.max("label")).first()[0]
    width = train.select(F.size(vec)).first()[0]
    steps = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), MultilayerPerceptronClassifier(layers=[width, *hidden, int(shape) + 1], maxIter=rounds, seed=seed)])
    return steps.fit(a).transform(ready(test, F.col(uid).alias("id"))).select("id", F.col("prediction").cast("int").alias("prediction"))
