"""Cleaning recipes: staged as steps, projected onto statistics, and applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprism.functions import fixed
from colprism.functions.columns import as_number, col, finite, nan_to_null, physicals
from colprism.operators.facts import number_facts
from colprism.operators.profile import _fences, quartiles, value_counts

STEP_FIELDS = "column string, action string, option string, position int"


def stage(recipe: list[dict], column: str, action: str, option: str | None = None) -> list[dict]:
    """Adds a step; one per column and action, so adding again replaces."""
    kept = [s for s in recipe if not (s["column"] == column and s["action"] == action)]
    return kept + [{"column": column, "action": action, "option": option}]


def recipe_table(spark, recipe: list[dict]) -> DataFrame:
    rows = [(s["column"], s["action"], s.get("option"), i) for i, s in enumerate(recipe)]
    return spark.createDataFrame(rows, STEP_FIELDS)


def project_profile(stats: DataFrame, recipe: DataFrame) -> DataFrame:
    """The statistics a staged recipe provably changes; the rest untouched."""
    has = lambda action: F.max(F.when(F.col("action") == action, F.lit(True)))
    steps = recipe.groupBy(F.col("column").alias("name")).agg(
        has("drop").alias("_drop"), has("impute").alias("_impute"), has("clip").alias("_clip"),
        F.max(F.when((F.col("action") == "cast") & (F.col("option") == "categorical"), F.lit(True))).alias("_cast"))
    joined = stats.join(F.broadcast(steps), "name", "left").where("_drop is null")
    return (joined
            .withColumn("missing_pct", F.when(F.col("_impute"), F.lit(0.0)).otherwise(F.col("missing_pct")))
            .withColumn("outliers", F.when(F.col("_clip"), F.lit(0)).otherwise(F.col("outliers")))
            .withColumn("outliers_pct", F.when(F.col("_clip"), F.lit(0.0)).otherwise(F.col("outliers_pct")))
            .withColumn("kind", F.when(F.col("_cast"), F.lit("categorical")).otherwise(F.col("kind")))
            .drop("_drop", "_impute", "_clip", "_cast"))


def _replace(df: DataFrame, changed: dict) -> DataFrame:
    return df.select(*[changed[c].alias(c) if c in changed else col(c) for c in df.columns])


def apply_drop(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c not in columns])


def fill_values(df: DataFrame, columns: dict[str, str]) -> dict[str, object]:
    """The value each column's gaps are filled with: mean, median or mode.

    Ties of the mode go to the smallest value. Frequencies are counted per
    (column, value) across tasks; only each column's best comes back.
    """
    df = nan_to_null(df)
    kinds = physicals(df)
    fills: dict[str, object] = {}
    means = [c for c, how in columns.items() if how == "mean"]
    if means:
        found = number_facts(df, {c: finite(as_number(c, kinds[c])) for c in means})
        fills.update({r["name"]: r["mean"] for r in found.collect()})
    medians = [c for c, how in columns.items() if how == "median"]
    if medians:
        fills.update({c: q[1] for c, q in quartiles(df, medians).items()})
    modes = [c for c, how in columns.items() if how == "mode"]
    if modes:
        fills.update(mode_values(df, modes))
    return fills


def mode_values(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The commonest value of each column as text, ties to the smallest value."""
    kinds = physicals(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    counted = value_counts(df, columns)
    numeric = [c for c in columns if kinds[c] in ("integer", "float")]
    order = F.when(F.col("name").isin(numeric), F.col("value").try_cast("double")) if numeric else F.lit(None).cast("double")
    best = counted.groupBy("name").agg(
        F.min_by("value", F.struct(-F.col("count"), order, F.col("value"))).alias("value"))
    found = {r["name"]: r["value"] for r in best.collect()}
    return {c: found.get(c) for c in columns if types[c] is not None}


def apply_impute(df: DataFrame, columns: dict[str, str], fills: dict[str, object] | None = None) -> DataFrame:
    """Fills missing cells; a mean or median makes an integer column double."""
    df = nan_to_null(df)
    fills = fill_values(df, columns) if fills is None else fills
    types = {f.name: f.dataType for f in df.schema.fields}
    changed = {}
    for c, how in columns.items():
        if fills.get(c) is None:
            continue
        kept = "double" if how in ("mean", "median") else types[c]
        changed[c] = F.coalesce(col(c).cast(kept), F.lit(fills[c]).cast(kept))
    return _replace(df, changed)


def apply_clip(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moves values beyond the 1.5 x IQR fences onto them."""
    df = nan_to_null(df)
    known = quartiles(df, columns)
    changed = {}
    for c in columns:
        if known[c][0] is not None:
            low, high = _fences(known[c])
            x = col(c).cast("double")
            changed[c] = F.when(x < low, low).when(x > high, high).otherwise(x)
    return _replace(df, changed)


def apply_log(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {c: F.log1p(col(c).cast("double")) for c in columns})


def apply_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean, unit population deviation; a column without spread becomes 0."""
    df = nan_to_null(df)
    kinds = physicals(df)
    found = {r["name"]: r for r in number_facts(df, {c: finite(as_number(c, kinds[c])) for c in columns}).collect()}
    changed = {}
    for c in columns:
        if c in found:
            changed[c] = (col(c).cast("double") - F.lit(found[c]["mean"])) / F.lit(found[c]["std"] or 1.0)
    return _replace(df, changed)


def apply_encode(df: DataFrame, column: str, how: str) -> DataFrame:
    """One indicator per category, or the category's share of the filled rows.

    One-hot is for few categories (the suggestion stops at 20); the frequency
    table is joined, and Spark broadcasts it only if it is small.
    """
    counted = value_counts(df.select(col(column)), [column])
    text = col(column).cast("string")
    if how == "one-hot":
        limit = fixed.FOLD_MAX
        values = sorted(r["value"] for r in counted.select("value").limit(limit + 1).collect())
        if len(values) > limit:
            raise ValueError("column '%s' has more than %d categories, encode it by frequency" % (column, limit))
        return df.select(
            *[col(c) for c in df.columns if c != column],
            *[F.coalesce((text == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values])
    total = df.agg(F.count(col(column))).first()[0]
    shares = counted.select(F.col("value").alias("_value"), (F.col("count") / F.lit(total or 1)).alias("_share"))
    return (df.withColumn("_text", text).join(shares, F.col("_text") == F.col("_value"), "left")
            .select(*[F.col("_share").alias(column) if c == column else col(c) for c in df.columns]))


def apply_cast(df: DataFrame, columns: list[str]) -> DataFrame:
    """Treats columns as categories from here on."""
    return _replace(df, {c: col(c).cast("string") for c in columns})


def apply_recipe(df: DataFrame, recipe: list[dict]) -> DataFrame:
    """Runs the steps in order, neighbouring steps of one kind in one pass."""
    at = 0
    while at < len(recipe):
        action, group = recipe[at]["action"], []
        while at < len(recipe) and recipe[at]["action"] == action:
            if recipe[at]["column"] in df.columns:
                group.append(recipe[at])
            at += 1
        columns = [s["column"] for s in group]
        if not columns:
            continue
        if action == "drop":
            df = apply_drop(df, columns)
        elif action == "impute":
            df = apply_impute(df, {s["column"]: s["option"] for s in group})
        elif action == "clip":
            df = apply_clip(df, columns)
        elif action == "log":
            df = apply_log(df, columns)
        elif action == "scale":
            df = apply_scale(df, columns)
        elif action == "cast":
            df = apply_cast(df, columns)
        elif action == "encode":
            for s in group:
                df = apply_encode(df, s["column"], s["option"])
        else:
            raise ValueError("unknown cleaning action '%s'" % action)
    return df
