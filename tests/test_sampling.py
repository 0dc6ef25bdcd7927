from pyspark.sql import functions as F

import pytest

from colprism.operators import sampling
from colprism.operators.sampling import sample_frame, with_draw
from colprism.plans.training import _reason
from colprism.sources import readers
from colprism.sources.tidy import clean_names


def _copies(spark):
    return spark.range(3000).select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("b"))


def test_draws_do_not_depend_on_the_layout(spark):
    df = _copies(spark)
    laid = [df.repartition(1), df.repartition(7), df.orderBy(F.desc("a")).repartition(3, "b").select("b", "a")]
    drawn = [sorted((r.a, r.b or "", r.u) for r in with_draw(x, "u").collect()) for x in laid]
    assert drawn[0] == drawn[1] == drawn[2] and len({u for *_, u in drawn[0]}) == 3000
    assert 0.45 < sum(u for *_, u in drawn[0]) / 3000 < 0.55


def test_samples_are_exact_after_a_shuffle(spark):
    df = _copies(spark)
    joined = df.join(df.select("a").distinct(), "a")
    found = [sorted(map(str, sample_frame(x, 500).collect())) for x in (joined, joined.repartition(5), df)]
    assert len(found[0]) == 500 and found[0] == found[1] == found[2]


def test_names_stay_unique():
    assert clean_names(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert clean_names([" ", "b", "b", ""], {1}) == ["column_0", "b", "column_2"]


def test_reasons_and_bounds_are_told(spark):
    assert _reason(ValueError("\n\n said\nmore")) == "said" and _reason(KeyError()) == "KeyError"
    with pytest.raises(readers.ReadError):
        readers.preview(spark.range(3), 5000)


def test_a_feature_may_not_be_named_like_an_internal_column(spark):
    from colprism.operators.schema import infer_schema
    from colprism.plans.task import plan
    from colprism.plans.training import train
    from colprism.session import pin
    df = spark.range(200).select(F.rand(1).alias("label"), F.rand(2).alias("a"), F.rand(3).alias("y"))
    with pytest.raises(ValueError, match="label"):
        train(df, plan(df, pin(infer_schema(df)), "y"), ["ridge"])


def test_a_sample_scans_the_table_without_shuffling_its_rows(spark):
    df = spark.range(5000).selectExpr("id", "repeat('x', 50) AS wide", "id % 3 AS c")
    shuffled = []
    seen = sampling.stable

    def watched(frame):
        shuffled.append("Exchange" in frame._jdf.queryExecution().executedPlan().toString() and "wide" in frame.columns)
        return seen(frame)
    sampling.stable = watched
    try:
        assert sample_frame(df, 700).count() == 700
    finally:
        sampling.stable = seen
    assert shuffled and not any(shuffled)


def test_copies_are_drawn_in_pieces(spark, monkeypatch):
    df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    whole = sorted(r.v for r in sample_frame(df, 900).collect())
    monkeypatch.setattr(sampling, "PIECE", 7)
    monkeypatch.setattr(sampling, "BROADCAST_KEYS", 0)
    assert sorted(r.v for r in sample_frame(df, 900).collect()) == whole
    assert 600 < whole.count(-1) < 750


def test_any_kind_of_column_can_be_drawn(spark):
    df = spark.range(60).selectExpr("map('a', id) AS m", "array(id, null) AS l", "struct(id, cast(null AS string) AS s) AS t",
                                    "cast(cast(id AS string) AS binary) AS b", "cast('nan' AS double) AS d", "date_add(DATE'2020-01-01', cast(id AS int)) AS day")
    assert sample_frame(df, 20).count() == 20 and sample_frame(df, 0).count() == 0
    assert with_draw(df, "u").select("u").distinct().count() == 60
