"""Health of a table and the fixes its statistics suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colprism.functions import fixed


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def health_score(stats: DataFrame, rows: int, duplicates: int) -> DataFrame:
    """0-100 from completeness, type consistency, duplicates and outliers."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    numeric = F.col("kind") == "numeric"
    missing = F.coalesce(F.sum("missing_pct") / n, F.lit(0.0))
    broken = F.count_if(F.col("kind").isin("empty", "constant")) / n
    outliers = F.coalesce(F.avg(F.when(numeric, F.coalesce("outliers_pct", F.lit(0.0)))), F.lit(0.0))
    repeated = F.lit(duplicates / rows if rows else 0.0)
    parts = stats.agg(
        _clamped(100 - missing).alias("completeness"),
        _clamped(100 - broken * 100).alias("consistency"),
        _clamped(100 - repeated * 200).alias("uniqueness"),
        _clamped(100 - outliers * 4).alias("outliers"))
    total = (0.4 * F.col("completeness") + 0.2 * F.col("consistency")
             + 0.2 * F.col("uniqueness") + 0.2 * F.col("outliers"))
    return parts.withColumn("score", F.floor(total + 0.5).cast("int"))


def diff_health(before: DataFrame, after: DataFrame) -> DataFrame:
    """Score and part differences of two one-row health tables."""
    names = ["score", "completeness", "consistency", "uniqueness", "outliers"]
    both = before.select(F.lit(0).alias("side"), *names).unionByName(after.select(F.lit(1).alias("side"), *names))
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    return both.agg(*[e for c in names for e in (
        pick(c, 0).alias(f"{c}_before"), pick(c, 1).alias(f"{c}_after"), (pick(c, 1) - pick(c, 0)).alias(f"{c}_change"))])


def grade_missing(pct: Column) -> Column:
    return F.when(pct >= 40, "critical").when(pct >= 5, "warning").otherwise("good")


def grade_score(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 55, "warning").otherwise("critical")


def grade_duplicates(pct: Column) -> Column:
    return F.when(pct >= 5, "critical").when(pct > 0, "warning").otherwise("good")


def suggest_fixes(stats: DataFrame) -> DataFrame:
    """Suggested cleaning steps, a row per (column, action), best first."""
    kind, missing, unique = F.col("kind"), F.col("missing_pct"), F.col("unique")
    skew = F.abs(F.coalesce("skew", F.lit(0.0)))
    numeric = kind == "numeric"
    dead = kind.isin("empty", "constant")
    option = F.when(numeric, F.when(skew >= 1, "median").otherwise("mean")).otherwise("mode")
    gaps = F.format_string("fills %.1f%% gaps", missing)

    def fix(condition, action, option, label, why):
        return F.when(condition, F.struct(
            F.lit(action).alias("action"), option.cast("string").alias("option"), label.alias("label"), why.alias("why")))

    none = F.lit(None)
    steps = F.array_compact(F.array(
        fix(kind == "empty", "drop", none, F.lit("Drop column"), F.lit("it has no values at all")),
        fix(kind == "constant", "drop", none, F.lit("Drop column"), F.lit("the same value in every row carries no signal")),
        fix(kind == "identifier", "drop", none, F.lit("Drop column"), F.lit("ids are unique per row and never generalise")),
        fix(~dead & (missing >= 60), "drop", none, F.lit("Drop column"),
            F.format_string("%.0f%% missing is too much to fill in honestly", missing)),
        fix(~dead & (missing > 0) & (missing < 60), "impute", option, F.concat(F.lit("Impute with "), option),
            F.when(option == "median", F.concat(gaps, F.lit("; median because the column is skewed")))
             .when(option == "mode", F.concat(gaps, F.lit(" with the most common value")))
             .otherwise(F.concat(gaps, F.lit(" with the average")))),
        fix(numeric & (skew >= 2) & (F.col("min") >= 0), "log", none, F.lit("Log-transform"),
            F.format_string("skew of %.1f squashes most values into a few bins", F.col("skew"))),
        fix(numeric & (F.col("outliers_pct") >= 2), "clip", none, F.lit("Clip outliers"),
            F.format_string("%.1f%% of values sit beyond 1.5 × IQR", F.col("outliers_pct"))),
        fix(numeric, "scale", none, F.lit("Standardise"), F.lit("linear models and k-means need features on one scale")),
        fix(kind.isin("categorical", "boolean") & (unique > 20), "encode", F.lit("frequency"), F.lit("Frequency-encode"),
            F.format_string("%d categories would explode into as many columns", unique)),
        fix(kind.isin("categorical", "boolean") & (unique <= 20), "encode", F.lit("one-hot"), F.lit("One-hot encode"),
            F.format_string("%d categories become %d indicator columns", unique, unique)),
        fix((kind == "text") & (F.col("unique_pct") < 5), "cast", F.lit("categorical"), F.lit("Cast to categorical"),
            F.format_string("only %d distinct values -- it behaves like a category", unique)),
    ))
    return (stats.select("ordinal", F.col("name").alias("column"), F.posexplode(steps).alias("position", "fix"))
            .select("ordinal", "column", "position", "fix.*"))


def shortlist_fixes(fixes: DataFrame, warnings: DataFrame, limit: int = 12) -> DataFrame:
    """The most useful fix of each column, columns with warnings first."""
    rank = F.when(F.col("level") == "high", 0).when(F.col("level") == "medium", 1).when(F.col("level") == "low", 2)
    # the last warning of a column decides its level
    last = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("_order")))
    levels = (warnings.where("column is not null").withColumn("_order", _issue_order())
              .withColumn("_last", last).where("_last = 1").select("column", "level"))
    first = F.row_number().over(Window.partitionBy("column").orderBy("position"))
    best = (fixes.where(F.col("action").isin("drop", "impute", "clip", "cast"))
            .withColumn("_first", first).where("_first = 1").drop("_first", "position"))
    return (best.join(F.broadcast(levels), "column", "left")
            .orderBy(F.coalesce(rank, F.lit(3)), "ordinal").limit(limit)
            .select("column", "level", "action", "option", "label", "why"))


def _issue_order() -> Column:
    """The order in which the profile raises the issues of one column."""
    issue = F.col("issue")
    return (F.when(issue.contains("values are missing"), 1).when(issue.contains("categories, rare"), 2)
            .when(issue.startswith("heavily skewed"), 3).when(issue.contains("outside the normal range"), 4).otherwise(0))
