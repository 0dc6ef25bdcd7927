"""Isolation forest: trees grown in parallel tasks, rows scored in batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colprism.operators.ranks import quantiles
from colprism.session import stable

SUBSAMPLE = 256


def average_path(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype="float64")
    out = np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), 0.0)
    return np.where(n == 2, 1.0, out)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One tree as (node, feature, cut, left, right, depth) rows; leaves have feature -1."""
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    made = 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        spread = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(spread) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        feature = int(rng.choice(spread))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = x[rows, feature] <= cut
        if left.all() or not left.any():
            cut = float(low[feature])
            left = x[rows, feature] <= cut
        nodes.append((node, feature, cut, made, made + 1, 0.0))
        todo += [(made, rows[left], depth + 1), (made + 1, rows[~left], depth + 1)]
        made += 2
    return nodes


def grow_forest(points: DataFrame, trees: int, seed: int = 0) -> tuple[pd.DataFrame, int]:
    """Trees over 256-row subsamples; ``points`` has key and array columns (id, x).

    Every row is offered to the same mean number of trees, distinct ones that
    its hash names, so that a tree is offered about ``wanted`` rows; of a large
    table most rows are offered to none. What is shuffled is a few subsamples
    per tree whatever the table's size.
    """
    total = points.count()
    size = min(SUBSAMPLE, total)
    wanted = 2 * size + 64
    unit = lambda *k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *k), 11) / F.lit(float(2 ** 53))
    rate = min(float(trees), trees * wanted / max(total, 1))
    times = (F.floor(F.lit(rate) + unit(F.col("id")))).cast("int")
    strides = F.array(*[F.lit(k) for k in range(1, trees + 1) if math.gcd(k, trees) == 1])
    begin, pick = (F.xxhash64(F.lit(seed + k), "id") for k in (1, 2))
    offered = (points.withColumn("times", F.least(times, F.lit(trees))).where("times > 0")
               .withColumn("stride", F.get(strides, F.pmod(pick, F.size(strides)).cast("int")))
               .withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
               .withColumn("tree", F.pmod(F.pmod(begin, F.lit(trees)) + F.col("nth") * F.col("stride"), F.lit(trees)).cast("int")))
    # groups hold a few hundred rows, so ranking them stays small
    first = F.row_number().over(Window.partitionBy("tree").orderBy(unit(F.col("tree"), F.col("id")), "id"))
    samples = offered.withColumn("at", first).where(F.col("at") <= size).select("tree", "at", "x")

    def grow(pdf):
        pdf = pdf.sort_values("at")
        tree = int(pdf["tree"].iloc[0])
        rows = _grow(np.array(pdf["x"].tolist()), np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(size, 2)))))
        return pd.DataFrame([(tree, *r) for r in rows], columns=["tree", "node", "feature", "cut", "left", "right", "length"])

    fields = "tree int, node int, feature int, cut double, left int, right int, length double"
    # at most 511 nodes per tree and 1,000 trees
    grown = samples.groupBy("tree").applyInPandas(grow, fields).toPandas()
    return grown.sort_values(["tree", "node"]).reset_index(drop=True), size


def score_rows(features: DataFrame, forest: pd.DataFrame, size: int) -> DataFrame:
    """Adds ``deviation``: near 1 is strange, below 0.5 is ordinary."""
    trees = [g[["feature", "cut", "left", "right", "length"]].to_numpy().T for _, g in forest.groupby("tree")]
    shared = features.sparkSession.sparkContext.broadcast(trees)
    norm = float(average_path(size)) or 1.0

    @F.pandas_udf("double")
    def deviation(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist())
        if not len(rows):
            return pd.Series([], dtype="float64")
        total = np.zeros(len(rows))
        for feature, cut, left, right, length in shared.value:
            feature, left, right = feature.astype(int), left.astype(int), right.astype(int)
            at = np.zeros(len(rows), dtype=int)
            walking = np.flatnonzero(feature[at] >= 0)
            while len(walking):
                node = at[walking]
                down = rows[walking, feature[node]] <= cut[node]
                at[walking] = np.where(down, left[node], right[node])
                walking = walking[feature[at[walking]] >= 0]
            total += length[at]
        return pd.Series(2.0 ** (-total / len(shared.value) / norm))

    return features.withColumn("deviation", deviation(vector_to_array("features")))


@dataclass
class Forest:
    """Fitted trees, the size of their subsamples, and the normality below which a row is an outlier."""

    trees: pd.DataFrame
    size: int
    cut: float

    def label(self, scored: DataFrame) -> DataFrame:
        """``cluster`` of rows that have a ``deviation``: -1 for outliers, 1 for normal rows."""
        return scored.withColumn("cluster", F.when(-F.col("deviation") < F.lit(self.cut), -1).otherwise(1))

    def score(self, features: DataFrame) -> DataFrame:
        """Rows it was not fitted on, with ``deviation`` and ``cluster``."""
        return self.label(score_rows(features, self.trees, self.size))


def fit_forest(features: DataFrame, key: str, trees: int = 150, contamination: float = 0.05,
               seed: int = 0) -> tuple[Forest, DataFrame]:
    """The forest, and the rows with ``deviation`` and ``cluster``."""
    points = features.select(F.col(key).alias("id"), vector_to_array("features").alias("x"))
    grown, size = grow_forest(points, trees, seed)
    scored = stable(score_rows(features, grown, size))
    cut = quantiles(scored, {"normality": -F.col("deviation")}, [contamination])["normality"][0]
    forest = Forest(grown, size, cut)
    return forest, forest.label(scored)


def isolation_forest(features: DataFrame, key: str, trees: int = 150, contamination: float = 0.05,
                     seed: int = 0) -> DataFrame:
    """The rows with ``deviation`` and ``cluster``: -1 for outliers, 1 for normal rows."""
    return fit_forest(features, key, trees, contamination, seed)[1]


def strangest_rows(scored: DataFrame, columns: list[str], limit: int = 10) -> DataFrame:
    """The rows with the largest deviation, with their original columns."""
    return scored.orderBy(F.desc("deviation")).limit(limit).select("deviation", *columns)
