"""k-means and density clustering on standardised features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.functions.coerce import ref
from tablewright.ml.density import dbscan
from tablewright.ml.features import SEED, assemble, encode_features
from tablewright.ml.kmeans import assign, fit_kmeans

RESTARTS = 10
POINTS = 2000


@dataclass(frozen=True)
class Clustered:
    """``assigned``: the input columns plus ``cluster``. ``points``: x, y, cluster.

    ``centres``: a row of standardised features for each cluster of k-means.
    """

    algorithm: str
    clusters_found: int
    silhouette: float | None
    sizes: DataFrame
    points: DataFrame
    assigned: DataFrame
    centres: np.ndarray | None = None


def standardise(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns become 0."""
    row = df.agg(
        *[
            f(ref(n)).alias(f"{stat}{i}")
            for i, n in enumerate(names)
            for stat, f in (("mean", F.avg), ("sd", F.stddev_pop))
        ]
    ).first()
    return df.withColumns(
        {
            n: (ref(n) - F.lit(row[f"mean{i}"])) / F.lit(row[f"sd{i}"] or 1.0)
            for i, n in enumerate(names)
        }
    )


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(ref(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("rows"))


def silhouette(df: DataFrame, cluster: str = "cluster") -> float | None:
    """Mean silhouette on squared Euclidean distance, a linear-time form.

    None with fewer than two clusters or when every row is its own cluster.
    """
    counts = cluster_sizes(df, cluster).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("rows").alias("rows")
    ).first()
    if counts["clusters"] < 2 or counts["clusters"] >= counts["rows"]:
        return None
    # The evaluator wants ids from 0; noise (-1) counts as a cluster of its own.
    shifted = df.withColumn("_cluster", ref(cluster) + 1)
    return ClusteringEvaluator(predictionCol="_cluster", featuresCol="features").evaluate(shifted)


def projection(df: DataFrame, names: Sequence[str], points: int = POINTS) -> DataFrame:
    """x, y, cluster of at most ``points`` rows drawn by hash; PCA beyond two features."""
    if len(names) > 2:
        fitted = PCA(k=2, inputCol="features", outputCol="_plane").fit(df)
        plane = vector_to_array(F.col("_plane"))
        placed = fitted.transform(df).select(
            plane[0].alias("x"), plane[1].alias("y"), "cluster", "features"
        )
    else:
        y = ref(names[1]) if len(names) > 1 else F.lit(0.0)
        placed = df.select(ref(names[0]).alias("x"), y.alias("y"), "cluster", "features")
    draw = F.xxhash64("x", "y", F.monotonically_increasing_id(), F.lit(SEED))
    return placed.orderBy(draw).limit(points).select("x", "y", "cluster")


def run_clustering(
    df: DataFrame,
    feature_columns: Sequence[str],
    algorithm: str | None = None,
    n_clusters: int = 4,
    eps: float = 0.8,
    min_points: int = 5,
    restarts: int = RESTARTS,
) -> Clustered:
    """k-means by default, DBSCAN on request."""
    if not feature_columns:
        raise ValueError("at least one feature is needed")
    if len(set(feature_columns)) < len(feature_columns):
        raise ValueError("a feature is named twice")
    encoded, names = encode_features(df, feature_columns)
    table = written(assemble(standardise(encoded, names), names))
    centres = None
    if algorithm == "dbscan":
        labelled = dbscan(table, names, eps, min_points)
    else:
        algorithm = "kmeans"
        points = table.select(*[ref(n).cast("double") for n in names])
        centres = fit_kmeans(points, n_clusters, restarts, SEED).centres
        labelled = assign(table, names, centres)
    labelled = written(labelled)
    sizes = cluster_sizes(labelled)
    found = sizes.where("cluster >= 0").count()
    return Clustered(
        algorithm=algorithm,
        clusters_found=found,
        silhouette=silhouette(labelled),
        sizes=sizes,
        points=projection(labelled, names),
        assigned=labelled.select(*[ref(c) for c in df.columns], "cluster"),
        centres=centres,
    )
