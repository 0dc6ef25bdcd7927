"""What single trees and forests need beyond MLlib: the absolute error, and a least size of nodes that are split.

A tree for the absolute error is grown level by level. For every node and
feature the rows are counted by (bin of the feature, bin of the target); the
medians on both sides of every cut come from running counts over the target's
bins. Counts are combined by Spark, one row per cell that has rows, and a task
looks at one (node, feature) at a time, at most 256 x ``TARGETS`` cells. If
the target has at most ``TARGETS`` values, medians and errors are exact; else a
bin's values count as their mean.

A node of fewer rows than ``least`` is not split. Whether a node is split does
not change another node's split, so cutting such nodes off a grown tree gives
the tree that growing with the rule gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprism.operators.boosting import BLOCK, BLOCK_ROWS, Tree, bin_cuts, java_tree, packed
from colprism.session import remove, scratch_path

TARGETS = 1024


@dataclass
class AbsoluteTree:
    """Fits a tree whose splits lower the sum of absolute deviations from the medians the most."""

    depth: int
    least_leaf: int = 1
    least_split: int = 2

    def fit(self, ready: DataFrame) -> FittedTree:
        spark = ready.sparkSession
        rows = ready.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"),
                            F.lit(1.0).alias("weight"), F.lit(False).alias("held"))
        one = rows.select(F.size("x").alias("n")).first()
        if one is None:
            raise ValueError("there are no rows to fit")
        cuts = bin_cuts(rows, one.n)
        target_cuts, values = _targets(rows)
        path = scratch_path(spark, "tree")
        rows.mapInArrow(packed(cuts, np.zeros(1), BLOCK_ROWS), BLOCK).write.parquet(path)
        try:
            tree = self._grown(spark.read.schema(BLOCK).parquet(path), target_cuts, values)
        finally:
            remove(spark, path)
        gains = np.zeros(len(cuts))
        for f, gain in zip(tree.feature, tree.gain):
            if f >= 0:
                gains[f] += gain
        model = DecisionTreeRegressionModel(java_tree(spark, tree, cuts))
        model.setFeaturesCol("features").setPredictionCol("prediction")
        return FittedTree([model], DenseVector(gains / (gains.sum() or 1.0)), tree, cuts)

    def _grown(self, blocks: DataFrame, target_cuts: np.ndarray, values: np.ndarray) -> Tree:
        tree = Tree([-1], [-1], [-1], [-1], [0.0], [0.0])
        active, depth = [0], 0
        while active:
            cells = (blocks.mapInArrow(_cells(tree, active, target_cuts), "node int, feature int, code int, n bigint, total double")
                     .groupBy("node", "feature", "code").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
            found = cells.groupBy("node", "feature").applyInArrow(
                _best(values, self.least_leaf), "node int, feature int, cut int, gain double, median double, error double, n bigint")
            # a row per node of this level
            best = found.groupBy("node").agg(
                F.max_by(F.struct("feature", "cut", "gain", "median", "error", "n"), F.struct("gain", -F.col("feature"))).alias("b"))
            grown = []
            for node, b in sorted((r.node, r.b) for r in best.collect()):
                tree.value[node] = b.median
                if depth < self.depth and b.n >= self.least_split and b.gain > 1e-12 * b.error:
                    tree.feature[node], tree.cut[node], tree.gain[node] = b.feature, b.cut, b.gain
                    tree.left[node], tree.right[node] = len(tree.feature), len(tree.feature) + 1
                    grown += [tree.left[node], tree.right[node]]
                    for column, empty in ((tree.feature, -1), (tree.cut, -1), (tree.left, -1), (tree.right, -1), (tree.value, 0.0), (tree.gain, 0.0)):
                        column += [empty, empty]
            active, depth = grown, depth + 1
        return tree


@dataclass
class FittedTree:
    stages: list[Transformer]
    featureImportances: DenseVector
    tree: Tree
    cuts: list[np.ndarray]


def _targets(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cuts of the target, and the value of every bin: the values themselves if they are few, else means."""
    few = rows.select("label").distinct().limit(TARGETS + 1).collect()
    if len(few) <= TARGETS:
        values = np.sort(np.array([r.label for r in few]))
        return values[:-1], values
    shares = F.array(*[F.lit(k / TARGETS) for k in range(1, TARGETS)])
    cuts = np.unique(np.array(rows.agg(F.percentile_approx("label", shares, 100_000)).first()[0], float))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1)
        for batch in batches:
            label = batch.column("label").to_numpy()
            at = np.searchsorted(cuts, label, "left")
            n += np.bincount(at, minlength=len(n))
            total += np.bincount(at, label, len(n))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array(total)], ["t", "n", "total"])

    sums = rows.select("label").mapInArrow(summed, "t int, n bigint, total double").groupBy("t").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    held = sorted((r.t, r.total / r.n) for r in sums.where("n > 0").collect())
    return cuts[[t for t, _ in held[:-1]]], np.array([mean for _, mean in held])


def _cells(tree: Tree, active: list[int], target_cuts: np.ndarray):
    """Rows and sums of targets by node, feature and (bin, target bin), of the rows of a block."""
    wanted = set(active)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, bins, label in zip(*(batch.column(c).to_pylist() for c in ("n", "bins", "label"))):
                bins, label = np.frombuffer(bins, np.uint8).reshape(-1, n), np.frombuffer(label, float)
                targets = np.searchsorted(target_cuts, label, "left")
                todo = [(0, np.arange(n))]
                while todo:
                    node, rows = todo.pop()
                    if tree.feature[node] >= 0:
                        left = bins[tree.feature[node]][rows] <= tree.cut[node]
                        todo += [(tree.left[node], rows[left]), (tree.right[node], rows[~left])]
                    elif node in wanted and len(rows):
                        for f, column in enumerate(bins):
                            codes, at = np.unique(column[rows].astype(np.int64) * TARGETS + targets[rows], return_inverse=True)
                            yield pa.RecordBatch.from_arrays([
                                pa.array(np.full(len(codes), node), pa.int32()), pa.array(np.full(len(codes), f), pa.int32()), pa.array(codes, pa.int32()),
                                pa.array(np.bincount(at), pa.int64()), pa.array(np.bincount(at, label[rows]))], ["node", "feature", "code", "n", "total"])
    return run


def _deviation(counts: np.ndarray, totals: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row of (row, target bin): rows, lower median's bin, and the sum of absolute deviations from it."""
    n, s = counts.cumsum(axis=1), totals.cumsum(axis=1)
    all_n, all_s = n[:, -1], s[:, -1]
    at = (2 * n >= all_n[:, None]).argmax(axis=1)
    rows = np.arange(len(n))
    m = values[at]
    below_n, below_s = n[rows, at] - counts[rows, at], s[rows, at] - totals[rows, at]
    inside = np.abs(totals[rows, at] - m * counts[rows, at])
    return all_n, at, m * below_n - below_s + (all_s - s[rows, at]) - m * (all_n - n[rows, at]) + inside


def _best(values: np.ndarray, least: int):
    def run(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        codes = cells.column("code").to_numpy()
        bins, at = np.unique(codes // TARGETS, return_inverse=True)
        counts, totals = np.zeros((len(bins), len(values))), np.zeros((len(bins), len(values)))
        counts[at, codes % TARGETS] = cells.column("n").to_numpy()
        totals[at, codes % TARGETS] = cells.column("total").to_numpy()
        left_n, left_s = counts.cumsum(axis=0), totals.cumsum(axis=0)
        (n,), (middle,), (error,) = _deviation(left_n[-1:], left_s[-1:], values)
        # an even number of rows has two middles
        later = np.flatnonzero(left_n[-1] * (np.arange(len(values)) > middle))
        even = 2 * left_n[-1][:middle + 1].sum() == n and len(later)
        median = (values[middle] + values[later[0]]) / 2 if even else values[middle]
        cut, gain = -1, 0.0
        if len(bins) > 1:
            n_left, _, e_left = _deviation(left_n[:-1], left_s[:-1], values)
            _, _, e_right = _deviation(left_n[-1] - left_n[:-1], left_s[-1] - left_s[:-1], values)
            gains = np.where((n_left >= least) & (n - n_left >= least), error - e_left - e_right, 0.0)
            best = int(gains.argmax())
            cut, gain = int(bins[best]), float(gains[best])
        made = {"node": [key[0].as_py()], "feature": [key[1].as_py()], "cut": [cut], "gain": [max(gain, 0.0)], "median": [float(median)],
                "error": [float(error)], "n": [int(n)]}
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.table([pa.array(v, k) for v, k in zip(made.values(), kinds)], names=list(made))
    return run


def with_least_split(model, least: int):
    """An MLlib tree or forest without the splits of nodes that have fewer than ``least`` rows."""
    if least <= 2:
        return model
    spark = SparkSession.getActiveSession()
    path, pruned = scratch_path(spark, "grown"), scratch_path(spark, "pruned")
    model.write().save(path)
    try:
        nodes = spark.read.parquet(f"{path}/data")
        prefix = "nodeData" if "nodeData" in nodes.columns else None
        fields = nodes.schema[prefix].dataType.names if prefix else nodes.columns
        at = lambda c: F.col(f"{prefix}.{c}") if prefix else F.col(c)
        leaf = {"gain": F.lit(-1.0), "leftChild": F.lit(-1), "rightChild": F.lit(-1),
                "split": F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
                                  F.lit(-1).alias("numCategories"))}
        made = [F.when(at("rawCount") < least, leaf[c]).otherwise(at(c)).alias(c) if c in leaf else at(c).alias(c) for c in fields]
        cut = nodes.select(*[c for c in nodes.columns if c != prefix], F.struct(*made).alias(prefix)) if prefix else nodes.select(*made)
        _copied(spark, path, pruned)
        cut.write.parquet(f"{pruned}/data")
        return type(model).load(pruned)
    finally:
        remove(spark, path)
        remove(spark, pruned)


def _copied(spark, source: str, target: str) -> None:
    """All of a saved model but its nodes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(source)
    files = place.getFileSystem(conf)
    for entry in files.listStatus(place):
        if entry.getPath().getName() != "data":
            jvm.org.apache.hadoop.fs.FileUtil.copy(files, entry.getPath(), files, jvm.org.apache.hadoop.fs.Path(f"{target}/{entry.getPath().getName()}"), False, conf)
