"""Diverse example rows: cluster the attributions and take the row nearest each centre."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import MAX_CLUSTERS, SEED
from tessera.functions.vectors import norm_distance
from tessera.operators.clean import col, zscore
from tessera.operators.trees import matrix
from tessera.session import cut_lineage, spread

PARALLEL_FITS = 4
# Points unlike each other from which on weights are used: with fewer than k, MLlib's weighted fit fails.
LEAST_POINTS = 100


def as_points(df: DataFrame, names: list[str], key: str = "idx") -> DataFrame:
    """``key, point``: the scaled columns as one array."""
    scaled = zscore(df, names)
    return scaled.select(key, F.array(*[col(c).cast("double") for c in names]).alias("point"))


def alike_once(points: DataFrame) -> DataFrame:
    """``idx, point, weight``: each point once, with the smallest of its keys and the number of its rows.

    Points of which most, or fewer than ``LEAST_POINTS``, are unlike each other stay as they are, without ``weight``.
    """
    least = F.when(F.count_if(F.col("idx").isNull()) == 0, F.min("idx"))  # a missing key is the smallest
    found = points.groupBy("point").agg(least.alias("idx"), F.count(F.lit(1)).cast("double").alias("weight"))
    written = cut_lineage(found.select("idx", "point", "weight"), "points-alike")
    return spread(written) if LEAST_POINTS <= (n := written.count()) <= points.count() / 2 else points


def weighted_silhouette(clustered: DataFrame) -> float:
    """``silhouette`` of ``point, cluster, weight``, where a point stands for ``weight`` rows at one place."""
    square = F.aggregate("point", F.lit(0.0), lambda total, v: total + v * v)
    stats = clustered.groupBy("cluster").agg(
        Summarizer.sum(array_to_vector("point"), F.col("weight")).alias("at"), F.sum("weight").alias("n"),
        F.sum(square * F.col("weight")).alias("square")).orderBy("cluster").collect()
    names = np.array([r["cluster"] for r in stats])
    n, squares = (np.array([r[c] for r in stats]) for c in ("n", "square"))
    sums = np.array([r["at"].toArray() for r in stats])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x, weight = matrix(batch.column("point")), batch.column("weight").to_numpy()
            own = np.arange(len(x)), np.searchsorted(names, batch.column("cluster").to_numpy())
            away = (x ** 2).sum(axis=1)[:, None] + squares / n - 2 * (x @ sums.T) / n
            size = n[own[1]]
            inside = away[own] * size / np.maximum(size - 1, 1)  # a row is not among those it is compared with
            away[own] = np.inf
            outside = away.min(axis=1)
            most = np.maximum(inside, outside)
            value = np.divide(outside - inside, most, out=np.zeros(len(x)), where=(most > 0) & (size > 1))
            total += float((value * weight).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])
    rows = clustered.select("point", "cluster", "weight").mapInArrow(totals, "total double")
    return rows.agg(F.sum("total")).first()[0] / float(n.sum())


def silhouette(clustered: DataFrame) -> float:
    """Mean silhouette of ``point, cluster`` under squared Euclidean distance, in linear time."""
    if "weight" in clustered.columns:
        return weighted_silhouette(clustered)
    vectors = clustered.select(array_to_vector("point").alias("features"), F.col("cluster").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(vectors)


def fit_clusters(points: DataFrame, k: int, seed: int = SEED) -> tuple[DataFrame, list[np.ndarray], int]:
    """K-means of ``idx, point`` or ``idx, point, weight``: rows with ``cluster``, the centres, and how many clusters have rows."""
    vectors = points.withColumn("features", array_to_vector("point"))
    means = KMeans(k=k, seed=seed, predictionCol="cluster")
    model = (means.setWeightCol("weight") if "weight" in points.columns else means).fit(vectors)
    filled = sum(size > 0 for size in model.summary.clusterSizes)
    return model.transform(vectors).drop("features"), model.clusterCenters(), filled


def fit_range(points: DataFrame, max_clusters: int = MAX_CLUSTERS,
              seed: int = SEED) -> dict[int, tuple[DataFrame, list[np.ndarray], float | None]]:
    """Clustered rows, centres and silhouette for each k = 2 .. min(max_clusters, floor(sqrt(rows))).

    The measure is the silhouette under squared Euclidean distance, at every size. Points with a ``weight`` stand for
    so many rows. The points are kept in memory and on disk while all k are fitted.
    """
    points = points.persist()

    def run(k: int) -> tuple[DataFrame, list[np.ndarray], float | None]:
        clustered, centres, filled = fit_clusters(points, k, seed)
        return clustered, centres, float(silhouette(clustered)) if filled > 1 else None
    try:
        rows = int(points.agg(F.sum("weight")).first()[0] or 0) if "weight" in points.columns else points.count()
        tried = range(2, min(max_clusters, math.isqrt(rows)) + 1)
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            return dict(zip(tried, pool.map(run, tried)))
    finally:
        points.unpersist()


def choose_k(points: DataFrame, max_clusters: int = MAX_CLUSTERS, seed: int = SEED) -> DataFrame:
    """``k, silhouette`` of every k tried."""
    fits = fit_range(points, max_clusters, seed)
    return points.sparkSession.createDataFrame([(k, f[2]) for k, f in fits.items()], "k int, silhouette double")


def best_k(scores: dict[int, float | None]) -> int:
    """The k of highest silhouette, the smallest of equals; 2 when no fit scored above -1."""
    best, top = 2, -1.0
    for k, value in sorted(scores.items()):
        if value is not None and value > top:
            best, top = k, value
    return best


def medoids(points: DataFrame, centre: Column) -> DataFrame:
    """``cluster, idx, distance``: the row nearest its centre, the smallest key of equals."""
    near = points.select("cluster", "idx", norm_distance(F.col("point"), centre).alias("distance"))
    return near.groupBy("cluster").agg(
        F.min_by("idx", F.struct("distance", "idx")).alias("idx"),
        F.min("distance").alias("distance"))


def medoids_of(clustered: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """Medoids for the centres of a fit, in cluster order."""
    table = clustered.sparkSession.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cluster int, _centre array<double>")
    return medoids(clustered.join(table, "cluster"), F.col("_centre")).orderBy("cluster")


def diverse_examples(attributions: DataFrame, max_clusters: int = MAX_CLUSTERS,
                     seed: int = SEED) -> DataFrame:
    """``cluster, idx, distance``: medoids of the best k-means of an attribution table.

    Rows alike are one point with their number as its weight, where most rows are like another.
    """
    if "idx" not in attributions.columns:
        raise KeyError("an attribution table must have an 'idx' column")
    names = [c for c in attributions.columns if c != "idx"]
    points = alike_once(spread(cut_lineage(as_points(attributions, names), "points")))
    fits = fit_range(points, max_clusters, seed)
    k = best_k({n: f[2] for n, f in fits.items()})
    clustered, centres = (fits[k] if k in fits else fit_clusters(points, k, seed))[:2]
    return medoids_of(clustered, centres)
