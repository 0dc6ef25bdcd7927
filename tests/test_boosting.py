"""Leaf-wise boosting against a plain numpy version that splits one leaf at a time."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import functions as F

from colprism.operators import boosting
from colprism.operators.boosting import LOGISTIC, SOFTMAX, SQUARED, Settings, fit_boosting


def plain_losses(x, y, w, cuts, s):
    """Mean losses before and after each round, every split searched by scanning all rows of a leaf."""
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    share = np.array([w[y == k].sum() for k in range(max(2, s.classes))]) / w.sum()
    raw = np.zeros((s.classes, len(y)))
    raw += np.average(y, weights=w) if s.loss == SQUARED else np.log(share[1] / share[0]) if s.loss == LOGISTIC else np.log(share)[:, None]
    losses = []
    for round_ in range(s.rounds + 1):
        if s.loss == SQUARED:
            each, slopes = 0.5 * (raw[0] - y) ** 2, [(w * (raw[0] - y), w)]
        elif s.loss == LOGISTIC:
            p = 1 / (1 + np.exp(-raw[0]))
            each, slopes = -np.log(np.where(y == 1, p, 1 - p)), [(w * (p - y), w * p * (1 - p))]
        else:
            p = np.exp(raw) / np.exp(raw).sum(0)
            each = -np.log(p[y.astype(int), np.arange(len(y))])
            slopes = [(w * (p[k] - (y == k)), w * p[k] * (1 - p[k])) for k in range(s.classes)]
        losses.append(np.average(each, weights=w))
        if round_ == s.rounds:
            return losses, raw
        for k, (g, h) in enumerate(slopes):
            leaves = [(np.arange(len(y)), 0)]
            while len(leaves) < s.leaves:
                best = None
                for i, (rows, depth) in enumerate(leaves):
                    if s.depth is not None and depth >= s.depth:
                        continue
                    for f, c in enumerate(cuts):
                        for cut in range(len(c)):
                            left = bins[rows, f] <= cut
                            if min(left.sum(), (~left).sum()) < s.least or min(h[rows][left].sum(), h[rows][~left].sum()) < 1e-3:
                                continue
                            part = lambda m: g[rows][m].sum() ** 2 / (h[rows][m].sum() + s.l2)
                            gain = part(left) + part(~left) - part(np.ones(len(rows), bool))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, i, rows[left], rows[~left], depth + 1
                if best is None:
                    break
                _, i, a, b, depth = best
                leaves[i:i + 1] = [(a, depth), (b, depth)]
            for rows, _ in leaves:
                raw[k, rows] -= s.learning_rate * g[rows].sum() / (h[rows].sum() + s.l2)


def planted(seed, n, classes):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 3, n), np.round(rng.exponential(size=n), 1), np.full(n, 4.0)], 1)
    signal = np.sin(2 * x[:, 0]) + 0.7 * x[:, 1] - 0.5 * x[:, 2]
    y = signal + rng.normal(0, 0.3, n)
    if classes:
        y = np.searchsorted(np.quantile(y, np.arange(1, classes) / classes), y).astype(float)
    return x, y, rng.uniform(0.5, 2, n).round(2)


def as_rows(spark, x, y, w):
    return spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)], ["features", "label", "weight"]).repartition(3)


@pytest.mark.parametrize("settings, classes", [
    (Settings(SQUARED, rounds=6, leaves=6, least=5, l2=3.0, learning_rate=0.3), 0),
    (Settings(LOGISTIC, rounds=5, leaves=5, least=4, l2=0.5, depth=2), 2),
    (Settings(SOFTMAX, 3, rounds=4, leaves=4, least=6, l2=1.0), 3),
])
def test_losses_equal_a_plain_version(spark, monkeypatch, settings, classes):
    monkeypatch.setattr(boosting, "BINS", 12)
    x, y, w = planted(1, 160, classes)
    rows = as_rows(spark, x, y, w)
    model = fit_boosting(rows, settings)
    want, raw = plain_losses(x, y, w, model.cuts, settings)
    assert [a for a, _ in model.losses] == pytest.approx(want, rel=1e-9) and all(b is None for _, b in model.losses)
    assert model.featureImportances[3] == 0 and sum(model.featureImportances) == pytest.approx(1)
    scored = PipelineModel(model.stages).transform(rows)
    found = {tuple(r.features): r for r in scored.collect()}
    got = np.array([found[tuple(a)].prediction for a in x])
    assert got == pytest.approx(raw[0] if classes == 0 else (raw[0] > 0) * 1.0 if classes == 2 else raw.argmax(0))
    if classes == 2:
        p = {tuple(r.features): r.p for r in scored.select("features", F.get(vector_to_array("probability"), F.lit(1)).alias("p")).collect()}
        assert np.array([p[tuple(a)] for a in x]) == pytest.approx(1 / (1 + np.exp(-raw[0])))


@pytest.mark.parametrize("loss, classes", [(SQUARED, 0), (SOFTMAX, 3)])
def test_many_blocks_grow_the_trees_of_one(spark, monkeypatch, loss, classes):
    x, y, w = planted(2, 400, classes)
    rows = as_rows(spark, x, y, w)
    settings = Settings(loss, max(1, classes), rounds=5, leaves=7, least=10)
    one = fit_boosting(rows, settings)
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 0)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    many = fit_boosting(rows, settings)
    assert [(t.feature, t.cut, t.left) for r in many.trees for t in r] == [(t.feature, t.cut, t.left) for r in one.trees for t in r]
    assert np.array(many.losses, float) == pytest.approx(np.array(one.losses, float), nan_ok=True)


@pytest.mark.parametrize("loss, classes", [(SQUARED, 0), (LOGISTIC, 2), (SOFTMAX, 4)])
def test_rounds_end_when_held_rows_get_no_better(spark, loss, classes):
    x, y, w = planted(3, 500, classes)
    rows = as_rows(spark, x, y, w).withColumn("held", F.pmod(F.xxhash64("features"), F.lit(4)) == 0)
    settings = Settings(loss, classes if loss == SOFTMAX else 1, rounds=150, learning_rate=0.4, least=5, early_stopping=True)
    model = fit_boosting(rows, settings, "held")
    held = [b for _, b in model.losses]
    assert 0 < len(model.trees) < 150 and held[len(model.trees)] == min(held)
    assert len(held) - 1 - len(model.trees) >= boosting.PATIENCE
    fitted = [a for a, _ in model.losses]
    assert all(b < a for a, b in zip(fitted, fitted[1:]))


def test_odd_tables(spark):
    same = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), 3.0)] * 30, ["features", "label"])
    model = fit_boosting(same, Settings(SQUARED, rounds=3))
    assert not model.trees and PipelineModel(model.stages).transform(same).first().prediction == 3.0
    with pytest.raises(ValueError, match="no rows"):
        fit_boosting(same.limit(0), Settings(SQUARED))


def test_a_saved_model_scores_alike(spark, tmp_path):
    x, y, w = planted(4, 200, 3)
    rows = as_rows(spark, x, y, w)
    made = PipelineModel(fit_boosting(rows, Settings(SOFTMAX, 3, rounds=3, leaves=4)).stages)
    made.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(rows)
    assert again.columns == ["features", "label", "weight", "prediction"]
    assert sorted(map(tuple, again.select("label", "prediction").collect())) == sorted(map(tuple, made.transform(rows).select("label", "prediction").collect()))


def test_the_driver_gets_splits_and_no_histograms(spark, monkeypatch):
    import pickle
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 0)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    sent, total = [], boosting._Store.total

    def watched(store, asked):
        found = total(store, asked)
        sent.append(len(pickle.dumps(found)))
        return found
    monkeypatch.setattr(boosting._Store, "total", watched)
    x, y, w = planted(5, 400, 3)
    model = fit_boosting(as_rows(spark, x, y, w), Settings(SOFTMAX, 3, rounds=2, leaves=4, least=10))
    assert len(model.trees) == 2 and max(sent) < 6_000
