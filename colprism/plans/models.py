"""MLlib estimators for each algorithm and its settings."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor

from colprism.functions.fixed import MULTICLASS, REGRESSION
from colprism.operators import boosting
from colprism.operators.trees import AbsoluteTree

SEED = 0
MAX_BINS = 64
# MB of sums that a task of a forest holds in a pass: more are fewer passes over the rows, with the same splits
# where a node looks at all features (else what it looks at is drawn in the order of the passes)
FOREST_MB, DRAWN_MB = 512, 256
# MLlib grows trees level by level, up to 30; this many stand for "unlimited" at every size
DEEPEST, UNLIMITED = 30, 14


def depth_of(value: int | None) -> int:
    return min(value, DEEPEST) if value else UNLIMITED


def boosting_settings(task: str, params: dict, classes: int) -> boosting.Settings:
    loss = boosting.SQUARED if task == REGRESSION else boosting.SOFTMAX if task == MULTICLASS else boosting.LOGISTIC
    return boosting.Settings(
        loss, classes if task == MULTICLASS else 1, params["learning_rate"], params["max_iter"], params["max_leaf_nodes"],
        params["max_depth"], params["min_samples_leaf"], params["l2_regularization"], params["early_stopping"])


def make_model(algorithm: str, task: str, params: dict, rows: int, label_std: float = 1.0):
    """An unfitted estimator over ``features`` and ``label`` (and ``weight`` for classes)."""
    regression = task == REGRESSION
    common = {"featuresCol": "features", "labelCol": "label"}
    if not regression:
        common["weightCol"] = "weight"
    if algorithm == "random_forest":
        settings = dict(common, numTrees=params["n_estimators"], maxDepth=depth_of(params["max_depth"]),
                        minInstancesPerNode=params["min_samples_leaf"], featureSubsetStrategy=params["max_features"],
                        bootstrap=params["bootstrap"], maxBins=MAX_BINS, seed=SEED,
                        maxMemoryInMB=FOREST_MB if params["max_features"] == "all" else DRAWN_MB)
        return RandomForestRegressor(**settings) if regression else RandomForestClassifier(**settings)
    if algorithm == "decision_tree":
        settings = dict(common, maxDepth=depth_of(params["max_depth"]),
                        minInstancesPerNode=params["min_samples_leaf"], maxBins=MAX_BINS, seed=SEED)
        criterion = params["criterion"]
        if regression:
            if criterion == "absolute_error":
                return AbsoluteTree(depth_of(params["max_depth"]), params["min_samples_leaf"], params["min_samples_split"])
            return DecisionTreeRegressor(**settings)
        return DecisionTreeClassifier(**settings, impurity="gini" if criterion == "gini" else "entropy")
    if algorithm == "logistic_regression":
        if regression:
            raise ValueError("logistic_regression predicts classes, the target is a number")
        return LogisticRegression(**common, regParam=1.0 / (params["C"] * rows), maxIter=params["max_iter"],
                                  standardization=False)
    if algorithm == "ridge":
        if not regression:
            raise ValueError("ridge predicts numbers, the target has classes")
        # MLlib scales the penalty by the label's deviation
        return LinearRegression(**common, regParam=params["alpha"] * (label_std or 1.0) / rows, elasticNetParam=0.0,
                                standardization=False, solver="normal")
    raise ValueError("unknown algorithm '%s'" % algorithm)
