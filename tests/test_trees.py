"""Trees for the absolute error against a search over all cuts, and the least size of nodes that are split."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor

from colprism.operators import trees as T
from colprism.operators.trees import AbsoluteTree, with_least_split
from colprism.plans.models import make_model
from colprism.plans.params import resolve


def table(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(3)


def planted(seed, n=240, values=9):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.normal(size=n).round(1), np.full(n, 2.0)], 1)
    y = np.where(x[:, 0] > 7, 10, 3) + np.where(x[:, 1] > 0.2, 2, 0) + rng.integers(0, values, n) * (rng.random(n) < 0.4)
    return x, y.astype(float)


def grown(x, y, depth, leaf, split):
    """The tree as a function, by a search over every value of every column; ties go to the first column and the lowest cut."""
    off = lambda v: np.abs(v - np.median(v)).sum()
    best = None
    if depth and len(y) >= split:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                gain = off(y) - off(y[left]) - off(y[~left])
                if min(left.sum(), (~left).sum()) >= leaf and gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, cut
    if best is None:
        return lambda row: np.median(y)
    _, f, cut = best
    left = x[:, f] <= cut
    a, b = grown(x[left], y[left], depth - 1, leaf, split), grown(x[~left], y[~left], depth - 1, leaf, split)
    return lambda row: a(row) if row[f] <= cut else b(row)


@pytest.mark.parametrize("depth, leaf, split", [(0, 1, 2), (1, 1, 2), (3, 1, 2), (4, 15, 60)])
def test_splits_and_medians_equal_a_search(spark, monkeypatch, depth, leaf, split):
    monkeypatch.setattr(T, "BLOCK_ROWS", 50)
    x, y = planted(depth)
    want = grown(x, y, depth, leaf, split)
    fitted = AbsoluteTree(depth, leaf, split).fit(table(spark, x, y))
    found = {tuple(r.features): r.prediction for r in fitted.stages[0].transform(table(spark, x, y)).collect()}
    assert [found[tuple(a)] for a in x] == pytest.approx([want(a) for a in x])
    assert fitted.featureImportances[2] == 0


def test_many_target_values_are_binned(spark, monkeypatch):
    monkeypatch.setattr(T, "TARGETS", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, 2))
    y = np.where(x[:, 0] > 0.5, 50.0, 0.0) + rng.normal(size=800)
    fitted = AbsoluteTree(1).fit(table(spark, x, y))
    assert fitted.tree.feature[0] == 0 and abs(fitted.cuts[0][fitted.tree.cut[0]] - 0.5) < 0.1
    low, high = sorted(fitted.tree.value[1:])
    assert low == pytest.approx(np.median(y[x[:, 0] <= 0.5]), abs=0.2) and high == pytest.approx(np.median(y[x[:, 0] > 0.5]), abs=1)


def test_one_row_and_equal_rows(spark):
    fitted = AbsoluteTree(3).fit(table(spark, np.ones((5, 1)), [2.0, 2, 9, 9, 9]))
    assert fitted.tree.feature == [-1] and fitted.tree.value == [9.0]
    with pytest.raises(ValueError, match="no rows"):
        AbsoluteTree(3).fit(table(spark, np.ones((1, 1)), [2.0]).limit(0))


@pytest.mark.parametrize("kind", [DecisionTreeClassifier, DecisionTreeRegressor, RandomForestClassifier])
def test_small_nodes_are_not_split(spark, tmp_path, kind):
    x, y = planted(5)
    rows = table(spark, x, (y > 8) * 1.0)
    model = kind(maxDepth=6, seed=3).fit(rows)
    pruned = with_least_split(model, 70)
    pruned.write().save(str(tmp_path / "m"))
    saved = spark.read.parquet(str(tmp_path / "m" / "data"))
    if "nodeData" in saved.columns:
        saved = saved.select("treeID", "nodeData.*")
    inner = saved.where("leftChild >= 0")
    assert inner.count() > 0 and inner.where("rawCount < 70").count() == 0
    # what is left is the top of what was grown: every row gets the value of the last node of at least 70 rows
    assert model.getNumTrees == pruned.getNumTrees if hasattr(model, "getNumTrees") else pruned.numNodes < model.numNodes
    assert with_least_split(model, 2) is model


def test_settings_that_were_refused_now_make_models(spark):
    x, y = planted(6)
    rows = table(spark, x, y)
    for algorithm, values in (("decision_tree", {"criterion": "absolute_error", "min_samples_split": 30}), ("decision_tree", {"min_samples_split": 30}),
                              ("random_forest", {"min_samples_split": 30, "n_estimators": 10})):
        made = make_model(algorithm, "regression", resolve(algorithm, "regression", values), len(y), 1.0).fit(rows)
        assert made.featureImportances[0] > 0
