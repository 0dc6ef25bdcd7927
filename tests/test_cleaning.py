import pytest
from pyspark.sql import functions as F

from colprism.operators import cleaning, profile, quality
from colprism.session import pin


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(i, None if i % 10 == 0 else float(i % 7) ** 4, None if i % 4 == 0 else "ab"[i % 2], "x") for i in range(200)]
    return spark.createDataFrame(rows, "id int, value double, word string, same string").persist()


@pytest.fixture(scope="module")
def stats(holes):
    return pin(profile.column_stats(holes))


def test_staging_again_replaces(spark):
    recipe = cleaning.stage(cleaning.stage([], "a", "impute", "mean"), "b", "drop")
    recipe = cleaning.stage(recipe, "a", "impute", "median")
    assert [(s["column"], s["option"]) for s in recipe] == [("b", None), ("a", "median")]


def test_suggestions(stats):
    found = {(r["column"], r["action"]): r["option"] for r in quality.suggest_fixes(stats).collect()}
    assert ("same", "drop") in found and ("id", "drop") in found
    assert found[("word", "impute")] == "mode" and found[("value", "impute")] == "median"
    assert found[("word", "encode")] == "one-hot"
    assert not [k for k in found if k[0] == "same" and k[1] != "drop"]


def test_applied_recipe_agrees_with_its_projection(spark, holes, stats):
    recipe = []
    for c, a, o in (("same", "drop", None), ("word", "impute", "mode"), ("value", "impute", "median")):
        recipe = cleaning.stage(recipe, c, a, o)
    projected = pin(cleaning.project_profile(stats, cleaning.recipe_table(spark, recipe)))
    applied = profile.column_stats(cleaning.apply_recipe(holes, recipe))
    want = {r["name"]: r["missing_pct"] for r in projected.collect()}
    assert want == {r["name"]: r["missing_pct"] for r in applied.collect()}
    before = quality.health_score(stats, 200, 0)
    after = quality.health_score(projected, 200, 0)
    assert quality.diff_health(before, after).first()["score_change"] > 0


def test_clip_and_scale(holes):
    clipped = cleaning.apply_clip(holes, ["value"])
    q = profile.quartiles(holes, ["value"])["value"]
    assert clipped.agg(F.max("value")).first()[0] <= q[2] + 1.5 * (q[2] - q[0])
    row = cleaning.apply_scale(holes, ["value"]).agg(F.avg("value"), F.stddev_pop("value")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1)


def test_health_is_bounded(spark):
    empty = spark.createDataFrame([("a", "empty", 100.0, None), ("b", "constant", 0.0, None)],
                                  "name string, kind string, missing_pct double, outliers_pct double")
    row = quality.health_score(empty, 10, 9).first()
    assert (row["consistency"], row["uniqueness"], row["outliers"]) == (0, 0, 100)


def test_missing_columns_are_thinned(spark):
    df = spark.range(3).select(*[F.lit(i).alias(f"c{i}") for i in range(100)])
    assert len(profile.missing_matrix(df, ["c0"]).columns) == 49
