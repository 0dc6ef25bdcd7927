"""Grouping rows: k-means with a chosen k, and the Euclidean silhouette."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprism.functions import fixed
from colprism.operators.sampling import sample_frame

CANDIDATES = [2, 3, 4, 5, 6, 7, 8]


def _best_kmeans(features: DataFrame, k: int, restarts: int, max_iter: int, workers: int = 4):
    """The restart with the lowest cost."""
    def fit(seed):
        return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(features)
    with ThreadPoolExecutor(workers) as pool:
        models = list(pool.map(fit, range(restarts)))
    return min(models, key=lambda m: m.summary.trainingCost)


def choose_k(features: DataFrame, restarts: int = 5, rows: int = fixed.SILHOUETTE_ROWS) -> int:
    """The k from 2 to 8 with the best silhouette on at most 5,000 rows."""
    sample = sample_frame(features.select("features"), rows).persist()
    n = sample.count()
    best, best_score = CANDIDATES[0], -2.0
    for k in CANDIDATES:
        if k >= n:
            break
        labelled = _best_kmeans(sample, k, restarts, 300).transform(sample)
        score = euclidean_silhouette(labelled)
        if score is not None and score > best_score:
            best, best_score = k, score
    sample.unpersist()
    return best


def fit_kmeans(features: DataFrame, params: dict) -> tuple[object, DataFrame, int]:
    k = params.get("n_clusters") or choose_k(features)
    model = _best_kmeans(features, k, params["n_init"], params["max_iter"])
    return model, model.transform(features), k


def euclidean_silhouette(labelled: DataFrame, label: str = "cluster", rows: int = fixed.SILHOUETTE_ROWS) -> float | None:
    """Mean silhouette without noise, on at most ``rows`` rows; None below two clusters.

    The sample is bounded, so each task gets it whole and measures its own
    share of the rows against it.
    """
    clean = labelled.where(F.col(label) != -1).select(vector_to_array("features").alias("x"), F.col(label).alias("c"))
    sample = sample_frame(clean, rows)
    pdf = sample.toPandas()
    if pdf["c"].nunique() < 2 or pdf["c"].nunique() >= len(pdf):
        return None
    x, c = np.array(pdf["x"].tolist()), pdf["c"].to_numpy()
    groups = np.unique(c)
    member = (c[:, None] == groups[None, :]).astype("float64")
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast((x, c, groups, member))

    def widths(batches):
        points, marks, names, inside = shared.value
        sizes = inside.sum(axis=0)
        squares = (points * points).sum(axis=1)
        for batch in batches:
            for start in range(0, len(batch), 512):
                at = batch["at"].to_numpy()[start:start + 512]
                own = points[at]
                apart = np.sqrt(np.maximum(
                    (own * own).sum(axis=1)[:, None] + squares[None, :] - 2 * own @ points.T, 0))
                apart[np.arange(len(at)), at] = 0.0
                sums = apart @ inside
                mine = np.searchsorted(names, marks[at])
                rest = np.arange(len(at))
                alone = sizes[mine] == 1
                a = sums[rest, mine] / np.maximum(sizes[mine] - 1, 1)
                means = sums / sizes[None, :]
                means[rest, mine] = np.inf
                b = means.min(axis=1)
                value = np.where(alone, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
                yield pd.DataFrame({"s": value})

    tasks = min(spark.sparkContext.defaultParallelism, max(1, len(x) // 512))
    found = spark.range(0, len(x), 1, tasks).withColumnRenamed("id", "at").mapInPandas(widths, "s double").agg(F.avg("s")).first()[0]
    shared.unpersist()
    return None if found is None else round(found, 4)
