"""Splits, thresholds and scores over DataFrames of labels and predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colprism.operators.ordering import running_total
from colprism.operators.ranks import order_values, quantiles
from colprism.session import pin

CUTS = [0.02 + i * 0.04 for i in range(25)]


def stratified_cuts(df: DataFrame, share: float, draw: str, label: str | None) -> tuple[Column, int]:
    """A condition that holds for exactly the test rows, and how many those are.

    Each class gives up its share, remainders going to the largest fractions,
    so that ``ceil(share * rows)`` rows are held out in all. The cut of each
    class is the drawn number at that rank: counting passes, no sort, and no
    task that holds a whole class.
    """
    if label is None:
        classes = {None: df.count()}
    else:
        # a classification target has at most 50 classes
        classes = {r[0]: r[1] for r in df.groupBy(label).count().orderBy(label).collect()}
    total = sum(classes.values())
    wanted = math.ceil(share * total)
    if label is not None and min(classes.values()) < 2:
        label, classes = None, {None: total}
    exact = {c: wanted * n / total for c, n in classes.items()}
    taken = {c: math.floor(v) for c, v in exact.items()}
    for c in sorted(classes, key=lambda c: taken[c] - exact[c])[:wanted - sum(taken.values())]:
        taken[c] += 1
    names = {c: f"c{i}" for i, c in enumerate(classes)}
    exprs = {names[c]: F.col(draw) if c is None else F.when(F.col(label) == c, F.col(draw)) for c in classes}
    ranges = {names[c]: (n, 0.0, 1.0) for c, n in classes.items()}
    found = order_values(df, exprs, {names[c]: [taken[c] - 1] for c in classes if taken[c]}, ranges)
    condition = F.lit(False)
    for c in classes:
        if taken[c]:
            below = F.col(draw) <= F.lit(found[(names[c], taken[c] - 1)])
            condition = condition | (below if c is None else (F.col(label) == c) & below)
    return condition, wanted


def train_test_split(df: DataFrame, share: float, draw: str, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, stratified by ``label`` if every class has two rows."""
    condition, _ = stratified_cuts(df, share, draw, label)
    return df.where(~condition), df.where(condition)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight per class that makes classes count alike: n / (classes x n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy()
    return counts.select(label, "count", (F.sum("count").over(whole) / (
        F.count(F.lit(1)).over(whole) * F.col("count"))).alias("weight"))


def tune_threshold(scored: DataFrame, truth: str, score: str) -> float | None:
    """The score cut with the best balanced accuracy among 25 quantiles, first wins.

    ``truth`` is 1.0 for the positive class. All cuts are judged in one scan.
    """
    found = quantiles(scored, {"s": F.col(score)}, CUTS)["s"]
    if found[0] is None:
        return None
    positive = F.col(truth) == 1
    wide = [F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")]
    for i, cut in enumerate(found):
        wide += [F.count_if(positive & (F.col(score) >= cut)).alias(f"tp{i}"),
                 F.count_if(~positive & (F.col(score) < cut)).alias(f"tn{i}")]
    row = scored.agg(*wide).first()
    sides = [(row["p"], "tp"), (row["n"], "tn")]
    best, best_score = 0.5, -1.0
    for i, cut in enumerate(found):
        recalls = [row[f"{k}{i}"] / n for n, k in sides if n]
        value = sum(recalls) / len(recalls)
        if value > best_score:
            best, best_score = cut, value
    return round(best, 4)


def predict_at(scored: DataFrame, score: str, threshold: float | None, out: str = "prediction") -> DataFrame:
    """Positive from the threshold on."""
    if threshold is None:
        return scored
    return scored.withColumn(out, F.when(F.col(score) >= threshold, F.lit(1.0)).otherwise(F.lit(0.0)))


def confusion(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    """Rows per (actual, predicted)."""
    return predictions.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))


def confusion_shares(table: DataFrame) -> DataFrame:
    """Each cell as a share of its actual class."""
    return table.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("actual")))


def classification_metrics(table: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, weighted F1 and test rows from a confusion table."""
    sides = table.select(F.col("actual").alias("label"), F.col("count").alias("a"), F.lit(0).alias("p"),
                         F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0).alias("hit")).unionAll(
        table.select(F.col("predicted"), F.lit(0), F.col("count"), F.lit(0)))
    per = sides.groupBy("label").agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("a") + F.col("p")), F.lit(0.0))
    return per.agg(
        F.try_divide(F.sum("hit"), F.sum("a")).alias("accuracy"),
        F.avg(F.when(F.col("a") > 0, F.col("hit") / F.col("a"))).alias("balanced_accuracy"),
        F.try_divide(F.sum(f1 * F.col("a")), F.sum("a")).alias("f1"),
        F.sum("a").alias("test_rows"))


def roc_auc(scored: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half, exact.

    Scores are first counted per distinct value; a distributed running total
    then tells how many negatives lie below each.
    """
    s = F.col(score).cast("double")
    per = scored.where(s.isNotNull()).groupBy(s.alias("s")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    ranked = running_total(per, [F.col("s")], F.col("neg"), "below")
    wins = F.sum((F.col("below") + F.col("neg") / 2) * F.col("pos"))
    return ranked.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def regression_metrics(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """R2, MAE, RMSE, MAPE over non-zero actuals, test rows: one aggregate."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = y - p
    n = F.count(F.lit(1))
    return predictions.agg(
        (1 - F.try_divide(F.sum(error * error), F.var_pop(y) * n)).alias("r2"),
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.when(y != 0, F.abs(F.try_divide(error, y)))) * 100).alias("mape_pct"), n.alias("test_rows"))


def cluster_sizes(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """Rows per cluster, noise kept as -1."""
    return labelled.groupBy(F.col(label).alias("cluster")).agg(F.count(F.lit(1)).alias("count"))


def cluster_shares(sizes: DataFrame) -> DataFrame:
    return sizes.withColumn("pct", F.col("count") / F.sum("count").over(Window.partitionBy()) * 100)


def labels_preview(labelled: DataFrame, order_by: list[str], label: str = "cluster", rows: int = 200) -> DataFrame:
    return labelled.orderBy(*order_by).limit(rows).select(*order_by, label)


def score_name(task: str) -> str:
    return {"regression": "r2", "clustering": "silhouette"}.get(task, "balanced accuracy")


def pinned_row(df: DataFrame) -> dict:
    return pin(df, 10).first().asDict()
