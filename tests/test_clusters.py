import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from colprism.operators import anomalies, clusters, density
from colprism.plans.task import plan
from colprism.plans.training import train
from colprism.sinks import exports


def points(spark, x, label=None):
    rows = [(i, [float(v) for v in row], 0 if label is None else int(label[i])) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, cluster int").repartition(3)
    return df.select("id", array_to_vector("x").alias("features"), "cluster")


def distances(x, metric):
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return 1 - u @ u.T
    diff = x[:, None, :] - x[None, :, :]
    return np.abs(diff).sum(axis=2) if metric == "manhattan" else np.sqrt((diff ** 2).sum(axis=2))


def brute_dbscan(x, eps, least, metric):
    """Core flags, core components and noise, straight from the definition."""
    near = distances(x, metric) <= eps
    core = near.sum(axis=1) >= least
    group = -np.ones(len(x), dtype=int)
    for start in range(len(x)):
        if core[start] and group[start] < 0:
            todo, group[start] = [start], start
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if group[j] < 0:
                        group[j] = start
                        todo.append(j)
    reach = [set(group[np.flatnonzero(near[i] & core)]) for i in range(len(x))]
    return core, group, reach


@pytest.mark.parametrize("dims,eps,metric,leaf", [(2, 0.25, "euclidean", 512), (2, 0.3, "manhattan", 8), (3, 0.35, "euclidean", 20),
                                                  (4, 0.6, "euclidean", 5), (2, 0.004, "cosine", 16), (64, 4.6, "euclidean", 12)])
def test_dbscan_equals_brute_force(spark, monkeypatch, dims, eps, metric, leaf):
    monkeypatch.setattr(density, "LEAF", leaf)
    rng = np.random.default_rng(dims)
    # blobs, a bridge of points, far noise, and a third of all rows on one spot
    x = np.vstack([rng.normal(0, 0.25, (60, dims)), rng.normal(2, 0.25, (60, dims)), rng.uniform(-2, 4, (30, dims)),
                   np.linspace(0, 2, 15)[:, None] * np.ones(dims), np.full((80, dims), 0.5)])
    core, group, reach = brute_dbscan(x, eps, 5, metric)
    found = {r["id"]: r["cluster"] for r in density.dbscan(
        points(spark, x).drop("cluster"), "id", eps, 5, metric).select("id", "cluster").collect()}
    assert len(found) == len(x)
    matched = {}
    for i in range(len(x)):
        if core[i]:
            assert matched.setdefault(group[i], found[i]) == found[i] >= 0
    assert len(set(matched.values())) == len(matched)
    for i in range(len(x)):
        if not core[i]:
            assert (found[i] == -1) if not reach[i] else found[i] in {matched[g] for g in reach[i]}


def test_dense_places_are_decided_by_boxes(spark, monkeypatch):
    """Of balls narrower than the reach few leaves are compared: those that hold other spots too."""
    monkeypatch.setattr(density, "LEAF", 16)
    compared = []
    monkeypatch.setattr(density, "_compared", lambda pairs, *rest, was=density._compared: compared.append(pairs.count()) or was(pairs, *rest))
    rng = np.random.default_rng(5)
    x = np.vstack([rng.uniform(0, 0.01, (900, 3)), rng.uniform(3, 3.01, (300, 3)), rng.uniform(8, 30, (40, 3))])
    found = {r["id"]: r["cluster"] for r in density.dbscan(points(spark, x).drop("cluster"), "id", 0.5, 10).select("id", "cluster").collect()}
    assert [found[i] for i in (0, 899, 900, 1199, 1200)] == [0, 0, 1, 1, -1]
    # counting, linking and borders, each of all pairs of leaves
    assert len(compared) == 3 and sum(compared) < 0.1 * 3 * (len(x) / 16) ** 2


def test_dbscan_of_odd_tables(spark):
    same = points(spark, np.ones((30, 2))).drop("cluster")
    assert {r["cluster"] for r in density.dbscan(same, "id", 0.1, 30).collect()} == {0}
    assert {r["cluster"] for r in density.dbscan(same, "id", 0.1, 31).collect()} == {-1}
    assert density.dbscan(same.limit(0), "id").count() == 0


def test_silhouette_equals_the_definition(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(3, 1, (50, 3)), [[9, 9, 9]]])
    label = np.array([0] * 40 + [1] * 50 + [2])
    d, values = distances(x, "euclidean"), []
    for i in range(len(x)):
        own = (label == label[i]).sum()
        a = d[i][label == label[i]].sum() / max(own - 1, 1)
        b = min(d[i][label == g].mean() for g in set(label) - {label[i]})
        values.append(0 if own == 1 else (b - a) / max(a, b))
    assert clusters.euclidean_silhouette(points(spark, x, label)) == pytest.approx(np.mean(values), abs=1e-4)
    assert clusters.euclidean_silhouette(points(spark, x, label * 0)) is None


def test_k_is_found_and_noise_is_left_out(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    assert clusters.choose_k(points(spark, x).drop("cluster"), restarts=2) == 3


def test_isolation_forest_finds_the_far_points(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (400, 3)), rng.uniform(6, 9, (8, 3))])
    found = anomalies.isolation_forest(points(spark, x).drop("cluster"), "id", 60, 0.05)
    outliers = {r["id"] for r in found.where("cluster = -1").collect()}
    assert set(range(400, 408)) <= outliers and len(outliers) == 21
    top = anomalies.strangest_rows(found, ["id"], 8)
    assert {r["id"] for r in top.collect()} == set(range(400, 408))


def test_every_tree_of_a_large_table_gets_its_subsample(spark):
    df = spark.range(20_000).select("id", F.array(F.rand(1), F.rand(2)).alias("x"))
    forest, size = anomalies.grow_forest(df, 10)
    assert size == 256 and set(forest["tree"]) == set(range(10))


def test_clustering_without_a_target(spark, frame, schema):
    run = train(frame, plan(frame, schema), ["kmeans", "isolation_forest", "ridge"], {"kmeans": {"n_clusters": 4, "n_init": 2}})
    by = {r.algorithm: r for r in run.results}
    assert by["kmeans"].metrics["clusters"] == 4 and by["kmeans"].sizes.count() == 4
    assert 0 < by["isolation_forest"].metrics["outliers_pct"] < 20
    assert not by["ridge"].ok and by["isolation_forest"].examples.count() == 10


def test_a_saved_forest_scores_with_its_own_trees_and_cut(spark, frame, schema, tmp_path):
    run = train(frame, plan(frame, schema), ["isolation_forest"], {"isolation_forest": {"n_estimators": 50}})
    exports.export_pipeline(run, "isolation_forest", str(tmp_path), spark)
    first = {r["tree"]: r["cluster"] for r in exports.score_table(spark, str(tmp_path), frame).select("tree", "cluster").collect()}
    outliers = [k for k, c in first.items() if c == -1]
    assert outliers
    # ordinary rows alone: none becomes an outlier because the others are gone
    ordinary = frame.where(~frame["tree"].isin(outliers))
    assert exports.score_table(spark, str(tmp_path), ordinary).where("cluster = -1").isEmpty()
