"""Writing results: recipes, schemas, leaderboards, reports and replayable pipelines."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprism.functions import fixed
from colprism.functions.columns import as_number, cell_text, col, finite, nan_to_null, physicals
from colprism.functions.fixed import BINARY, CLUSTERING, REGRESSION
from colprism.operators.anomalies import Forest
from colprism.operators.density import dbscan
from colprism.operators.evaluate import classification_metrics, confusion, predict_at, regression_metrics, train_test_split
from colprism.operators.sampling import cap_rows, with_draw
from colprism.plans.models import SEED
from colprism.plans.training import DRAW, ID, Training
from colprism.session import pin, stable


def export_recipe(dataset: str, steps: DataFrame, path: str) -> None:
    """The staged steps of a dataset as JSON lines."""
    steps.select(F.lit(dataset).alias("dataset"), *steps.columns).coalesce(1).write.mode("overwrite").json(path)


def export_schema(meta: DataFrame, schema: DataFrame, path: str) -> None:
    """One JSON document with meta and the columns in order."""
    columns = schema.agg(F.sort_array(F.collect_list(F.struct(*schema.columns))).alias("schema"))
    described = pin(meta).select(F.struct(*meta.columns).alias("meta"), F.lit(1).alias("k")).join(
        pin(columns).withColumn("k", F.lit(1)), "k").drop("k")
    described.coalesce(1).write.mode("overwrite").json(path)


def export_results(training: Training, spark: SparkSession, path: str) -> None:
    training.leaderboard(spark).coalesce(1).write.mode("overwrite").json(path)


def _markdown(head: list[str], rows: list[list]) -> str:
    lines = [head, ["---"] * len(head), *rows]
    return "\n".join("| " + " | ".join(str(cell).replace("|", "\\|") for cell in line) + " |" for line in lines)


def training_report(name: str, plan, training: Training) -> str:
    """A Markdown page of a finished run: what was asked, each model with its settings, drivers, failures, notes."""
    def shown(algorithm: str) -> str:
        return fixed.ALGORITHM_NAMES.get(algorithm, algorithm.replace("_", " "))

    fitted = [r for r in training.results if r.ok]
    failed = [r for r in training.results if not r.ok]
    columns = sum(map(len, plan.features.values())) - len(plan.features["dropped"])
    opening = [fixed.TASK_NAMES.get(training.task, training.task) + (f" of `{training.target}`" if training.target else "")
               + f": {plan.task_reason}.",
               f"{len(fitted)} of {len(training.results)} models were fitted to {training.rows_used} rows"
               + (", a sample," if training.rows_sampled else "") + f" and {columns} columns in {training.seconds:.1f} seconds."]
    if training.task != CLUSTERING:
        opening.append(f"Scores come from {training.test_size:.0%} of the rows, which no model has seen.")
    models = [[place, shown(r.algorithm), "" if r.score is None else round(r.score, 4), round(r.fit_seconds, 2),
               "; ".join(f"{k} = {v}" for k, v in sorted(r.params.items()))] for place, r in enumerate(fitted, 1)]
    page = [f"# {name}", " ".join(opening), f"## Leaderboard ({training.score_name})",
            _markdown(["place", "model", "score", "seconds", "settings"], models)]
    if failed:
        page += ["## Not fitted", _markdown(["model", "reason"], [[shown(r.algorithm), r.error] for r in failed])]
    if training.best is not None:
        drivers = training.best.importance.orderBy("rank").limit(10).collect()
        if drivers:
            page += [f"## Columns that {shown(training.best.algorithm)} relies on",
                     _markdown(["column", "weight"], [[f"`{d['column']}`", round(d["weight"], 4)] for d in drivers])]
    if plan.notes:
        page += ["## Mind", "  \n".join(plan.notes)]
    return "\n\n".join(page) + "\n"


def write_report(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_pipeline(training: Training, algorithm: str, path: str, spark: SparkSession) -> dict:
    """Saves a fitted pipeline with a manifest that is enough to replay its score."""
    result = next((r for r in training.results if r.algorithm == algorithm and r.ok), None)
    if result is None:
        raise ValueError("this run has no result for '%s'" % algorithm)
    manifest = {
        "algorithm": algorithm, "task": training.task, "target": training.target, "columns": result.columns,
        "used": result.used,
        "features": result.prepared.names, "sources": result.prepared.sources, "scaled": result.prepared.scaled,
        "params": result.params, "seed": SEED, "test_size": training.test_size, "max_rows": training.max_rows,
        "threshold": result.metrics.get("threshold"), "labels": result.labels,
        "clusters": result.metrics.get("clusters"), "score": result.score, "score_name": training.score_name,
    }
    if result.forest is not None:
        manifest["forest"] = {"size": result.forest.size, "cut": result.forest.cut}
        spark.createDataFrame(result.forest.trees).write.mode("overwrite").parquet(f"{path}/forest")
    result.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load_pipeline(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()["value"])
    return PipelineModel.load(f"{path}/pipeline"), manifest


def score_table(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """New rows with their prediction: class text, number or cluster; a forest keeps its trees and its cut."""
    pipeline, manifest = load_pipeline(spark, path)
    task, name = manifest["task"], manifest["algorithm"]
    df = nan_to_null(df)
    if name == "isolation_forest":
        # at most 1,000 trees of 511 nodes
        trees = spark.read.parquet(f"{path}/forest").toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        forest = Forest(trees, manifest["forest"]["size"], manifest["forest"]["cut"])
        return forest.score(pipeline.transform(df)).drop("features")
    if name == "dbscan":
        keyed = stable(pipeline.transform(df.withColumn(ID, F.monotonically_increasing_id())))
        p = manifest["params"]
        return dbscan(keyed, ID, p["eps"], p["min_samples"], p["metric"]).drop(ID, "features")
    scored = pipeline.transform(df)
    if task == CLUSTERING:
        return scored.drop("features")
    if task == BINARY and "probability" in scored.columns:
        scored = predict_at(scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))),
                            "score", manifest["threshold"])
    if task != REGRESSION:
        names = F.array(*[F.lit(v) for v in manifest["labels"]])
        scored = scored.withColumn("prediction", F.get(names, F.col("prediction").cast("int")))
    return scored.drop("features", "rawPrediction", "probability")


def replay(spark: SparkSession, path: str, df: DataFrame) -> float:
    """The score of a saved supervised pipeline on the holdout it was scored on."""
    pipeline, manifest = load_pipeline(spark, path)
    target, task = manifest["target"], manifest["task"]
    frame = nan_to_null(df).select(*[col(c) for c in manifest["used"]], col(target)).where(col(target).isNotNull())
    frame, _ = cap_rows(frame, manifest["max_rows"])
    if task == REGRESSION:
        frame = frame.withColumn("label", finite(as_number(target, physicals(frame)[target]))).where("label is not null")
    else:
        dtype = {f.name: f.dataType for f in frame.schema.fields}[target]
        names = F.array(*[F.lit(v) for v in manifest["labels"]])
        frame = (frame.withColumn("__class", cell_text(target, dtype))
                 .withColumn("label", (F.array_position(names, F.col("__class")) - 1).cast("double")))
    frame = stable(with_draw(frame, DRAW, SEED).withColumn(ID, F.monotonically_increasing_id()))
    _, test = train_test_split(frame, manifest["test_size"], DRAW, None if task == REGRESSION else "label")
    scored = pipeline.transform(test)
    if task == REGRESSION:
        return regression_metrics(scored, "label", "prediction").first()["r2"]
    if task == BINARY and "probability" in scored.columns:
        scored = predict_at(scored.withColumn("__score", F.get(vector_to_array("probability"), F.lit(1))),
                            "__score", manifest["threshold"])
    return classification_metrics(confusion(scored, "label", "prediction")).first()["balanced_accuracy"]

