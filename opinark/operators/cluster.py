"""Vectors and k-means: unit rows, hashed text vectors, fixed and learnt centroids, cluster sizes."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str, floor: float = 1e-12) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    norm = F.greatest(F.sqrt(dot(c, c)), F.lit(floor))
    return F.transform(c, lambda x: x.cast("double") / norm)


def hashed_text_vectors(df: DataFrame, words: str, size: int = 1 << 12, into: str = "features") -> DataFrame:
    """Unit vectors of word counts by hash: the embedder where no model is at hand."""
    counted = HashingTF(inputCol=words, outputCol="_tf", numFeatures=size).transform(df)
    return Normalizer(inputCol="_tf", outputCol=into).transform(counted).drop("_tf")


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, iterations: int = 20, into: str = "cluster_id") -> DataFrame:
    """df with the cluster of each vector (array column), learnt over all rows."""
    data = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(featuresCol="_v", predictionCol=into, k=k, seed=seed, maxIter=iterations).fit(data)
    return model.transform(data).drop("_v")


def nearest_centroid(df: DataFrame, vector: str, centroids: DataFrame, centroid_id: str, centroid: str) -> DataFrame:
    """The centroid of greatest cosine for each row, the smaller id on ties.

    Centroids are a model of fixed size: they are collected into one array literal column.
    """
    packed = centroids.agg(F.sort_array(F.collect_list(F.struct(F.col(centroid_id).alias("id"), l2_normalize(centroid).alias("c")))).alias("_cs"))
    unit = df.withColumn("_u", l2_normalize(vector)).crossJoin(F.broadcast(packed))
    best = F.array_max(F.transform("_cs", lambda c: F.struct(F.round(dot(F.col("_u"), c["c"]), 9).alias("cosine"), (-c["id"]).alias("id"))))
    return unit.withColumn("_b", best).select(*df.columns, (-F.col("_b.id")).alias("nearest"), F.round("_b.cosine", 6).alias("cosine"))


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """(n_clusters, smallest, largest, mean, median) of cluster sizes."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_clusters"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", 0.5), 6).alias("median"))
