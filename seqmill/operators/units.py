"""Feature units: active features, rotation of positions, k-means sweeps with silhouettes, principal components."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_features(rows: DataFrame, names: list[str], least: float = 1e-12) -> DataFrame:
    """(name, spread, active): features whose range over all rows is wider than ``least``."""
    got = rows.agg(*[(F.max(n) - F.min(n)).cast("double").alias(f"_{i}") for i, n in enumerate(names)])
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("spread")) for i, n in enumerate(names)])
    return got.select(F.explode(each).alias("r")).select("r.*", (F.col("r.spread") > least).alias("active"))


def supported_units(rows: DataFrame, unit: list[str], counted: str, least: int) -> DataFrame:
    """Rows of the units that have ``least`` or more non-null values."""
    good = rows.groupBy(*unit).agg(F.count(counted).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return rows.join(good, unit, "left_semi")


def centred(x: Column, y: Column, far: Column) -> Column:
    """(lateral, forward) seen from the player: the far half is turned by 180 degrees; null outside the court."""
    lateral, forward = F.when(far, 1 - x).otherwise(x), F.when(far, 2 * y).otherwise(2 * (1 - y))
    return F.when(lateral.between(0, 1) & forward.between(0, 1), F.struct(lateral.alias("lateral"), forward.alias("forward")))


def kmeans_sweep(rows: DataFrame, vector: str, ks: list[int], seed: int = 0, starts: int = 5) -> DataFrame:
    """(k, silhouette, least_size): the best of ``starts`` fits for each k, by cost.

    Spark's distributed k-means and silhouette (of squared distances) do the work; the driver
    holds one row for each k.
    """
    points = rows.select(array_to_vector(vector).alias("features")).cache()
    judge, out = ClusteringEvaluator(featuresCol="features", predictionCol="cluster"), []
    for k in ks:
        fits = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(points) for i in range(starts)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        out.append((k, float(judge.evaluate(best.transform(points))), int(min(best.summary.clusterSizes))))
    points.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, silhouette double, least_size long")


def best_k(sweep: DataFrame, least: int = 2) -> DataFrame:
    """The k of best silhouette among those whose clusters all have ``least`` members, or among all if none has."""
    return sweep.withColumn("eligible", F.col("least_size") >= least).orderBy(F.desc("eligible"), F.desc("silhouette"), "k").limit(1)


def clusters(rows: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """``rows`` with the cluster of their vector."""
    points = rows.withColumn("_features", array_to_vector(vector))
    return KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(points).transform(points).drop("_features")


def principal_components(rows: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """``rows`` with their first k principal components (of the centred vectors), signs as fitted."""
    points = rows.withColumn("_features", array_to_vector(vector))
    model = PCA(k=k, inputCol="_features", outputCol="_pc").fit(points)
    return model.transform(points).withColumn("components", vector_to_array("_pc")).drop("_features", "_pc")
