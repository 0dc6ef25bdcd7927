"""Training every requested algorithm and ranking the results."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprism.functions import fixed
from colprism.functions.columns import as_number, cell_text, col, finite, nan_to_null, physicals
from colprism.functions.fixed import BINARY, CLUSTERING, REGRESSION
from colprism.operators.anomalies import Forest, fit_forest, strangest_rows
from colprism.operators.boosting import fit_boosting
from colprism.operators.clusters import euclidean_silhouette, fit_kmeans
from colprism.operators.density import dbscan
from colprism.operators.evaluate import (
    class_weights, classification_metrics, cluster_sizes, confusion, labels_preview, pinned_row, predict_at,
    regression_metrics, roc_auc, score_name, train_test_split, tune_threshold,
)
from colprism.operators.features import SCALED, Prepared, prepare_features, split_features
from colprism.operators.importance import importances, permutation_importance
from colprism.operators.sampling import cap_rows, with_draw
from colprism.operators.trees import FittedTree, with_least_split
from colprism.plans.models import SEED, boosting_settings, make_model
from colprism.plans.params import resolve, validate_request
from colprism.plans.task import Plan
from colprism.session import pin, stable

VALIDATION = 0.2
EARLY_STOPPING = 0.1
TUNED_CLASS_ROWS = 20
TASK_ROWS = 100_000      # rows of a task that fits or scores,
SMALL_ROWS = 20_000      # and of a table that is not dealt over all cores
ID, DRAW = "__row", "__draw"
# columns that training and scoring add to a frame; a feature of such a name would be overwritten by the target or a score
RESERVED = {"label", "weight", "features", "prediction", "rawprediction", "probability", "score", ID, DRAW, "__class", "__score", "__redraw"}


@dataclass
class Result:
    algorithm: str
    ok: bool
    error: str | None = None
    score: float | None = None
    params: dict = field(default_factory=dict)
    columns: dict = field(default_factory=dict)
    used: list[str] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)
    fit_seconds: float = 0.0
    pipeline: PipelineModel | None = None
    prepared: Prepared | None = None
    forest: Forest | None = None
    labels: list[str] = field(default_factory=list)
    importance: DataFrame | None = None
    confusion: DataFrame | None = None
    labelled: DataFrame | None = None
    examples: DataFrame | None = None
    sizes: DataFrame | None = None
    holdout: DataFrame | None = None


@dataclass
class Training:
    task: str
    target: str | None
    rows_used: int
    rows_sampled: bool
    test_size: float
    max_rows: int | None
    feature_split: str
    results: list[Result]
    seconds: float = 0.0

    @property
    def best(self) -> Result | None:
        return self.results[0] if self.results and self.results[0].ok else None

    @property
    def score_name(self) -> str:
        return score_name(self.task)

    def leaderboard(self, spark: SparkSession) -> DataFrame:
        """A row per algorithm, best first, failures last."""
        rows = [(i + 1, r.algorithm, r.ok, r.score, self.score_name, r.error, json.dumps(r.params),
                 json.dumps(r.metrics), self.feature_split, r.fit_seconds) for i, r in enumerate(self.results)]
        return spark.createDataFrame(rows, "rank int, algorithm string, ok boolean, score double, score_name string, "
                                           "error string, params string, metrics string, feature_split string, fit_seconds double")


def project_features(df: DataFrame, plan: Plan) -> DataFrame:
    """The used features and the target, nothing else."""
    used = plan.features["numeric"] + plan.features["categorical"] + plan.features["temporal"]
    return df.select(*[col(c) for c in used + ([plan.target] if plan.target else [])])


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return nan_to_null(df).where(col(target).isNotNull())


def _reason(error: Exception) -> str:
    """The first line of an error that says something, or its kind."""
    return next((line.strip() for line in str(error).splitlines() if line.strip()), type(error).__name__)


def numeric_target_filter(df: DataFrame, target: str) -> DataFrame:
    """The target as a number, rows where it is none dropped."""
    number = finite(as_number(target, physicals(df)[target]))
    return df.withColumn("label", number).where("label is not null")


def train(df: DataFrame, plan: Plan, algorithms: list[str] | None = None, params: dict | None = None,
          test_size: float | None = None, max_rows: int | None = None, feature_split: str = "kind") -> Training:
    """Trains each algorithm on the same rows and ranks them; one failing is one failed row.

    ``feature_split="kind"`` encodes features by inferred kind, ``"dtype"``
    by physical type. ``max_rows`` caps the rows used; by default all are.
    """
    started = time.perf_counter()
    params, test_size = validate_request(plan.task, algorithms, params, test_size)
    wanted = algorithms or [a["name"] for a in plan.algorithms if a["recommended"]] or [plan.algorithms[0]["name"]]
    frame = nan_to_null(project_features(df, plan))
    if plan.target:
        frame = drop_missing_target(frame, plan.target)
    frame, sampled = cap_rows(frame, max_rows)
    used = [c for c in frame.columns if c != plan.target]
    kinds = None
    if feature_split == "kind":
        kinds = {c: k for role, k in (("numeric", "numeric"), ("categorical", "categorical"), ("temporal", "datetime"))
                 for c in plan.features[role]}
    clashing = sorted(RESERVED & {c.lower() for c in used})
    if clashing:
        raise ValueError("rename the features %s: training adds columns of these names" % ", ".join(clashing))
    columns = split_features(frame, used, kinds)
    labels: list[str] = []
    if plan.task == REGRESSION:
        frame = numeric_target_filter(frame, plan.target)
    elif plan.task != CLUSTERING:
        dtype = {f.name: f.dataType for f in frame.schema.fields}[plan.target]
        frame = frame.withColumn("__class", cell_text(plan.target, dtype))
        # class order is by text; at most 50 classes
        labels = sorted(r[0] for r in frame.select("__class").distinct().limit(fixed.MAX_CLASSES + 1).collect())
        if len(labels) > fixed.MAX_CLASSES:
            raise ValueError("column '%s' has more than %d classes" % (plan.target, fixed.MAX_CLASSES))
        frame = frame.withColumn("label", (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("__class")) - 1).cast("double"))
    # drawn numbers and row ids are written once, so that a lost executor cannot change the split
    rows = frame.count()
    frame = stable(spread(with_draw(frame, DRAW, SEED).withColumn(ID, F.monotonically_increasing_id()), rows))

    # preparations fitted so far: they depend on the rows and on scaling, not on the algorithm
    results, split, known = [], None, {}
    for name in wanted:
        begun = time.perf_counter()
        try:
            values = resolve(name, plan.task, params.get(name))
            if plan.task == CLUSTERING:
                result = _cluster(name, frame, columns, values, used)
            else:
                if split is None:
                    split = train_test_split(frame, test_size, DRAW, None if plan.task == REGRESSION else "label")
                result = _supervise(name, plan, split, columns, values, labels, known)
            result.params, result.columns, result.used = values, columns, used
        except Exception as error:  # one algorithm must not sink the others
            result = Result(name, ok=False, error=_reason(error))
        result.fit_seconds = time.perf_counter() - begun
        results.append(result)
    good = sorted((r for r in results if r.ok), key=lambda r: -(r.score if r.score is not None else float("-inf")))
    ordered = good + [r for r in results if not r.ok]
    if good and plan.task != CLUSTERING and good[0].importance.isEmpty():
        good[0].importance = permutation_importance(
            good[0].pipeline, good[0].holdout, used, DRAW, regression=plan.task == REGRESSION)
    return Training(plan.task, plan.target, rows, sampled, test_size, max_rows, feature_split, ordered,
                    time.perf_counter() - started)


def spread(drawn: DataFrame, rows: int) -> DataFrame:
    """The rows dealt over as many tasks as their number asks for: a file of few bytes is few tasks, whatever its rows grow to as vectors."""
    if rows <= SMALL_ROWS:
        return drawn
    return drawn.repartition(max(-(-rows // TASK_ROWS), drawn.sparkSession.sparkContext.defaultParallelism), DRAW)


def _weighted(frame: DataFrame, balanced: bool) -> DataFrame:
    if not balanced:
        return frame.withColumn("weight", F.lit(1.0))
    weights = {r["label"]: r["weight"] for r in class_weights(frame, "label").collect()}
    choice = F.lit(1.0)
    for label, weight in weights.items():
        choice = F.when(F.col("label") == label, weight).otherwise(choice)
    return frame.withColumn("weight", choice)


def _fit(name: str, task: str, rows: DataFrame, columns: dict, values: dict,
         known: dict, part: str, classes: int) -> tuple[PipelineModel, Prepared, object]:
    """The pipeline, its preparation, and the model that knows which features count."""
    scale = name in SCALED
    if (part, scale) not in known:
        known[part, scale] = prepare_features(rows, columns, scale)
    prepared = known[part, scale]
    ready = prepared.transform(rows)
    if task != REGRESSION:
        ready = _weighted(ready, values.get("class_weight") == "balanced")
    kept = [c for c in ("features", "label", "weight") if c in ready.columns]
    validation = None
    if name == "gradient_boosting" and values.get("early_stopping"):
        validation = "__validation"
        ready = ready.withColumn(validation, F.pmod(F.xxhash64(F.lit(7), F.col(ID)), F.lit(1000)) < EARLY_STOPPING * 1000)
        kept.append(validation)
    # the vectors are read once per iteration, so they are kept
    ready = ready.select(*kept)
    if name == "random_forest":
        # every task sends the sums of all nodes that a pass splits, so there are no more tasks than cores
        ready = ready.coalesce(ready.sparkSession.sparkContext.defaultParallelism)
    ready = ready.persist()
    try:
        if name == "gradient_boosting":
            model = fit_boosting(ready, boosting_settings(task, values, classes), validation)
            return PipelineModel([*prepared.stages(), *model.stages]), prepared, model
        size, std = ready.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
        model = make_model(name, task, values, size, std).fit(ready)
        if isinstance(model, FittedTree):
            return PipelineModel([*prepared.stages(), *model.stages]), prepared, model
        model = with_least_split(model, values.get("min_samples_split", 2))
    finally:
        ready.unpersist()
    return PipelineModel([*prepared.stages(), model]), prepared, model


def _probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("__score", F.get(vector_to_array("probability"), F.lit(1)))


def _threshold(name, plan, train_rows, columns, values, known) -> float | None:
    """Tuned on a slice of the training rows; the holdout is never seen."""
    if plan.task != BINARY:
        return None
    counts = [r["count"] for r in train_rows.groupBy("label").count().collect()]
    if len(counts) != 2 or min(counts) < TUNED_CLASS_ROWS:
        return None
    redrawn = train_rows.withColumn("__redraw", F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(ID)), 11) / F.lit(float(2 ** 53)))
    fit_rows, valid_rows = train_test_split(redrawn, VALIDATION, "__redraw", "label")
    tuned, _, _ = _fit(name, plan.task, fit_rows, columns, values, known, "tuning", 2)
    scored = tuned.transform(valid_rows)
    if "probability" not in scored.columns:
        return None
    scored = _probability(scored).select("label", "__score").persist()
    try:
        return tune_threshold(scored, "label", "__score")
    finally:
        scored.unpersist()


def _supervise(name: str, plan: Plan, split, columns, values, labels, known) -> Result:
    train_rows, test_rows = split
    with ThreadPoolExecutor(2) as pool:
        # the model and the threshold come from separate fits, so they run side by side
        tuned = pool.submit(_threshold, name, plan, train_rows, columns, values, known)
        pipeline, prepared, model = _fit(name, plan.task, train_rows, columns, values, known, "training", len(labels))
        threshold = tuned.result()
    spark = train_rows.sparkSession
    scored = pipeline.transform(test_rows)
    result = Result(name, ok=True, pipeline=pipeline, prepared=prepared, labels=labels, holdout=test_rows)
    if plan.task == REGRESSION:
        found = pinned_row(regression_metrics(scored, "label", "prediction"))
        result.metrics = {k: round(found[k], 2 if k == "mape_pct" else 4) if isinstance(found[k], float) else found[k]
                          for k in found}
        result.score = result.metrics["r2"]
    else:
        kept = ["label", "prediction"]
        if plan.task == BINARY and "probability" in scored.columns:
            scored = predict_at(_probability(scored), "__score", threshold)
            kept.append("__score")
        scored = scored.select(*kept).persist()
        table = pin(confusion(scored, "label", "prediction"))
        found = pinned_row(classification_metrics(table))
        if "__score" in kept:
            found.update(pinned_row(roc_auc(scored, "label", "__score")))
        scored.unpersist()
        result.metrics = {k: round(v, 4) if isinstance(v, float) else v for k, v in found.items()}
        result.metrics.update(threshold=threshold, labels=labels)
        names = F.array(*[F.lit(v) for v in labels])
        result.confusion = table.select(F.get(names, F.col("actual").cast("int")).alias("actual"),
                                        F.get(names, F.col("predicted").cast("int")).alias("predicted"), "count")
        result.score = result.metrics["balanced_accuracy"]
    result.importance = importances(spark, model, prepared.sources)
    return result


def _cluster(name: str, frame: DataFrame, columns, values, used) -> Result:
    if name not in ("kmeans", "dbscan", "isolation_forest"):
        raise ValueError("%s needs a target column" % name)
    prepared = prepare_features(frame, columns, name in SCALED)
    features = prepared.transform(frame).persist()
    result = Result(name, ok=True, prepared=prepared)
    spark = frame.sparkSession
    result.importance = spark.createDataFrame([], "rank int, column string, weight double")
    stages = prepared.stages()
    try:
        if name == "isolation_forest":
            result.forest, labelled = fit_forest(features, ID, values["n_estimators"], values["contamination"])
            counts = {r["cluster"]: r["count"] for r in cluster_sizes(labelled).collect()}
            outliers, total = counts.get(-1, 0), sum(counts.values())
            result.metrics = {"outliers": outliers, "outliers_pct": round(outliers / max(total, 1) * 100, 2),
                              "normal_rows": counts.get(1, 0)}
            result.examples = strangest_rows(labelled, used)
            result.pipeline, result.labelled = PipelineModel(stages), labelled.drop("features")
            return result
        if name == "kmeans":
            model, labelled, k = fit_kmeans(features, values)
            result.metrics = {"clusters": k}
            result.pipeline = PipelineModel([*stages, model])
        else:
            labelled = stable(dbscan(features, ID, values["eps"], values["min_samples"], values["metric"]))
            found = labelled.agg(F.max("cluster"), F.count_if(F.col("cluster") == -1)).first()
            result.metrics = {"clusters": found[0] + 1, "outliers": found[1]}
            result.pipeline = PipelineModel(stages)
        result.score = euclidean_silhouette(labelled)
        result.metrics["silhouette"] = result.score
        result.sizes = pin(cluster_sizes(labelled)) if name == "kmeans" else cluster_sizes(labelled)
        result.labelled = labelled.drop("features")
        return result
    finally:
        features.unpersist()
