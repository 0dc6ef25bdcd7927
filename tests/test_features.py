import pytest
from pyspark.ml.functions import vector_to_array

from colprism.operators import features as fe


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(f" {i}.5" if i % 5 else None, f"2024-01-{i % 28 + 1:02d}", "it's" if i % 2 else "back\\slash", True) for i in range(50)]
    return spark.createDataFrame(rows, "number string, day string, `odd name` string, flag boolean")


def test_texts_dates_and_awkward_categories_become_numbers(mixed):
    fitted = fe.prepare_features(mixed, {"numeric": ["number"], "categorical": ["odd name"], "temporal": ["day"]}, False)
    assert fitted.names[0] == "number" and "day__weekday" in fitted.names and "odd name_it's" in fitted.names
    row = fitted.transform(mixed.limit(2)).select(vector_to_array("features").alias("v")).collect()[1]["v"]
    values = dict(zip(fitted.names, row))
    # 2 January 2024 is a Tuesday
    assert (values["number"], values["day__day"], values["day__weekday"]) == (1.5, 2.0, 1.0)
    assert values["odd name_it's"] == 1.0 and values["odd name_back\\slash"] == 0.0


def test_unseen_and_rare_categories(spark):
    train = spark.createDataFrame([("a",)] * 150 + [("b",)] * 149 + [("rare",)], "c string")
    fitted = fe.prepare_features(train, {"numeric": [], "categorical": ["c"], "temporal": []}, False)
    assert fitted.names == ["c_a", "c_b", "c_infrequent"]
    new = spark.createDataFrame([("never seen",), (None,)], "c string")
    got = [r["v"] for r in fitted.transform(new).select(vector_to_array("features").alias("v")).collect()]
    assert got == [[0.0, 0.0, 1.0], [1.0, 0.0, 0.0]]


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (3.0,)], "x double")
    fitted = fe.prepare_features(df, {"numeric": ["x"], "categorical": [], "temporal": []}, True)
    got = sorted(r["v"][0] for r in fitted.transform(df).select(vector_to_array("features").alias("v")).collect())
    assert got == pytest.approx([-(2 ** 0.5), 0.0, 0.0, 2 ** 0.5])


def test_no_features_is_an_error(spark):
    with pytest.raises(ValueError, match="no usable feature"):
        fe.prepare_features(spark.createDataFrame([(None,)], "x double"), {"numeric": ["x"], "categorical": [], "temporal": []}, False)
