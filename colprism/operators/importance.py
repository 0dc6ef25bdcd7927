"""Which source columns drive a model."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colprism.functions.columns import col

TOP = 20
PERMUTED_ROWS = 1_000
REPEATS = 2
FIELDS = "rank int, column string, weight double"


def _ranked(spark: SparkSession, totals: dict[str, float], positive: bool = False) -> DataFrame:
    grand = sum(totals.values()) or 1.0
    ranked = [(c, v) for c, v in sorted(totals.items(), key=lambda kv: -kv[1]) if v > 0 or not positive]
    return spark.createDataFrame(
        [(i + 1, c, round(float(v) / grand, 4)) for i, (c, v) in enumerate(ranked[:TOP])], FIELDS)


def importances(spark: SparkSession, model, sources: list[str]) -> DataFrame:
    """Model weights summed per source column; no rows if the model has none."""
    if hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        weights = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        weights = np.abs(model.coefficients.toArray())
    else:
        return spark.createDataFrame([], FIELDS)
    totals: dict[str, float] = {}
    for source, weight in zip(sources, weights):
        totals[source] = totals.get(source, 0.0) + float(weight)
    return _ranked(spark, totals)


def permutation_importance(pipeline: Transformer, holdout: DataFrame, columns: list[str], draw: str,
                           regression: bool, rows: int = PERMUTED_ROWS, repeats: int = REPEATS) -> DataFrame:
    """Loss of score when one column is shuffled, on at most 1,000 holdout rows.

    Every (column, repeat) variant of the sample is scored in one pass. The
    score is accuracy for classes and R2 for numbers.
    """
    spark = holdout.sparkSession
    base = (holdout.orderBy(draw).limit(rows)
            .withColumn("_at", F.row_number().over(Window.orderBy(draw))).persist())
    variants = [(c, r) for c in range(-1, len(columns)) for r in range(repeats if c >= 0 else 1)]
    kinds = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c, r in variants])
    spread = base.withColumn("_v", F.explode(kinds)).select("*", F.col("_v.c").alias("_c"), F.col("_v.r").alias("_r")).drop("_v")
    # each variant holds the bounded sample once, so ranking inside it stays small
    shuffled = F.row_number().over(Window.partitionBy("_c", "_r").orderBy(F.xxhash64("_c", "_r", "_at"), "_at"))
    donors = base.select(F.col("_at").alias("_from"), *[col(c).alias(f"_d{i}") for i, c in enumerate(columns)])
    mixed = (spread.withColumn("_from", shuffled).join(F.broadcast(donors), "_from")
             .withColumns({c: F.when(F.col("_c") == i, F.col(f"_d{i}")).otherwise(col(c)) for i, c in enumerate(columns)}))
    y, p = F.col("label"), F.col("prediction")
    if regression:
        score = 1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(F.lit(1)))
    else:
        score = F.avg((y == p).cast("double"))
    found = pipeline.transform(mixed).groupBy("_c", "_r").agg(score.alias("s")).collect()
    base.unpersist()
    reference = next(r["s"] for r in found if r["_c"] == -1)
    totals = {}
    for i, c in enumerate(columns):
        drops = [reference - r["s"] for r in found if r["_c"] == i]
        totals[c] = max(sum(drops) / len(drops), 0.0)
    return _ranked(spark, totals, positive=True)
