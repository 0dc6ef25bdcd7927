import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colprism.operators.ranks import order_values, quantiles


@pytest.fixture(scope="module")
def hard(spark):
    """Ordinary, hot, heavy-tailed, constant and extreme values."""
    rng, n = np.random.default_rng(0), 12_000
    pdf = pd.DataFrame({
        "plain": rng.normal(size=n), "hot": np.where(rng.random(n) < 0.6, 5.0, rng.normal(size=n) * 10),
        "tail": np.exp(rng.normal(size=n) * 60), "same": np.ones(n), "big": rng.choice([-1.7e308, 0, 1, 1.7e308], n)})
    return pdf, spark.createDataFrame(pdf).repartition(5).persist()


def test_order_values_are_exact(hard):
    pdf, df = hard
    ranks = [0, 1, 2999, 3000, 5999, 6000, 11_998, 11_999]
    found = order_values(df, {c: F.col(c) for c in pdf}, {c: ranks for c in pdf}, gathered=200)
    for c in pdf:
        ordered = np.sort(pdf[c].to_numpy())
        assert [found[(c, r)] for r in ranks] == list(ordered[ranks])


def test_both_quantile_paths_agree_with_numpy(hard):
    pdf, df = hard
    names = ["plain", "hot", "same"]
    for limit in (0, 10**9):
        found = quantiles(df, {c: F.col(c) for c in names}, [0.0, 0.25, 0.5, 0.9, 1.0], buffered_cells=limit)
        for c in names:
            assert found[c] == pytest.approx(list(np.percentile(pdf[c], [0, 25, 50, 90, 100])))


def test_empty_column_has_no_quantiles(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [None]}
