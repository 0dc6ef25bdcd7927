import json

import pandas as pd
import numpy as np
import pytest

from colprism.operators.schema import infer_schema
from colprism.plans.task import plan
from colprism.plans.training import train
from colprism.session import pin
from colprism.sinks import exports
from colprism.sinks.registry import Registry
from sample_tables import TREES, to_spark


@pytest.fixture(scope="module")
def classified(frame, schema):
    return train(frame, plan(frame, schema, "sweet"), ["gradient_boosting", "logistic_regression", "decision_tree", "ridge"],
                 {"decision_tree": {"max_depth": 1}}, test_size=0.3)


@pytest.fixture(scope="module")
def regressed(frame, schema):
    return train(frame, plan(frame, schema, "harvest"), ["ridge", "random_forest"], {"random_forest": {"n_estimators": 12, "max_depth": 8}})


def test_classification_learns_the_signal(spark, classified):
    best = classified.results[0]
    assert best.score > 0.6 and classified.score_name == "balanced accuracy"
    assert best.metrics["roc_auc"] > 0.6 and best.confusion.count() > 0
    assert classified.leaderboard(spark).count() == 4


def test_settings_and_split_are_honoured(classified):
    tree = next(r for r in classified.results if r.algorithm == "decision_tree")
    assert tree.params["max_depth"] == 1 and tree.metrics["test_rows"] == round(0.3 * TREES)
    assert tree.pipeline.stages[-1].depth == 1


def test_a_broken_algorithm_does_not_sink_the_others(classified):
    assert [r.algorithm for r in classified.results if not r.ok] == ["ridge"]
    assert classified.results[-1].algorithm == "ridge" and classified.best is not None


def test_regression_recovers_a_linear_target(regressed):
    assert regressed.results[0].score > 0.9
    for r in regressed.results:
        assert {x["column"] for x in r.importance.orderBy("rank").limit(3).collect()} >= {"height", "variety"}


def test_importance_names_source_columns(frame, regressed):
    for r in regressed.results:
        assert {x["column"] for x in r.importance.collect()} <= set(frame.columns)


def test_the_winner_always_explains_itself(frame, schema):
    run = train(frame, plan(frame, schema, "variety"), ["gradient_boosting"], {"gradient_boosting": {"max_iter": 10, "max_leaf_nodes": 4}})
    assert run.results[0].ok and not run.results[0].importance.isEmpty()


def test_missing_values_and_row_cap(spark, trees):
    holey = pd.concat([trees] * 2, ignore_index=True).astype(object)
    rng = np.random.default_rng(1)
    for c in ("height", "variety", "picked"):
        holey.loc[rng.random(len(holey)) < 0.3, c] = None
    df = to_spark(spark, holey)
    p = plan(df, pin(infer_schema(df)), "sweet")
    run = train(df, p, ["decision_tree"], max_rows=800)
    assert run.results[0].ok and run.rows_used == 800 and run.rows_sampled


def test_features_split_by_type_on_request(frame, schema):
    run = train(frame, plan(frame, schema, "harvest"), ["ridge"], feature_split="dtype")
    assert "sweet" in run.results[0].columns["numeric"] and run.results[0].score > 0.9


@pytest.mark.parametrize("algorithm", ["logistic_regression", "gradient_boosting"])
def test_exported_classifier_reproduces_the_score(spark, frame, classified, tmp_path, algorithm):
    manifest = exports.export_pipeline(classified, algorithm, str(tmp_path), spark)
    assert exports.replay(spark, str(tmp_path), frame) == pytest.approx(manifest["score"], abs=0.02)
    scored = exports.score_table(spark, str(tmp_path), frame)
    assert scored.count() == TREES and {r[0] for r in scored.select("prediction").distinct().collect()} <= {"0", "1"}


def test_exported_regressor_reproduces_the_score(spark, frame, regressed, tmp_path):
    manifest = exports.export_pipeline(regressed, "ridge", str(tmp_path), spark)
    assert exports.replay(spark, str(tmp_path), frame) == pytest.approx(manifest["score"], abs=0.02)
    with pytest.raises(ValueError, match="no result"):
        exports.export_pipeline(regressed, "kmeans", str(tmp_path), spark)


def test_report_and_registry(spark, frame, schema, regressed, tmp_path):
    text = exports.training_report("sample", plan(frame, schema, "harvest"), regressed)
    assert "Leaderboard (r2)" in text and "Ridge regression" in text and "`height`" in text and "alpha = 1.0" in text
    kept = Registry(spark, str(tmp_path / "kept"))
    meta = spark.createDataFrame([("sample", TREES)], "name string, rows int")
    key = kept.register_dataset(frame, meta, schema)
    assert kept.load_dataset(key).count() == TREES and kept.list_datasets().count() == 1
    assert kept.describe_dataset(key)["suggested_targets"].first()["name"] == "sweet"
    saved = kept.save_run(key, regressed)
    run = kept.load_run(saved)
    assert run["best"] == regressed.best.algorithm and json.dumps(run["dataset"])
    assert run["leaderboard"].count() == len(regressed.results)
    assert run["importance"][run["best"]].count() == regressed.best.importance.count()
    kept.forget_dataset(key)
    assert kept.list_datasets().isEmpty()
    with pytest.raises(KeyError):
        kept.load_dataset(key)
    with pytest.raises(KeyError):
        kept.load_run(saved)
    assert not list((tmp_path / "kept").glob(f"*/{key}")) and not list((tmp_path / "kept" / "run").iterdir())
