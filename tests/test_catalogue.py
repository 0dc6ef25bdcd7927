import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sample_tables import TESTDATA
from tools.check import canonical

FOLDER = f"{TESTDATA}/sf0.001"
CHECKED = [
    "read_csv", "tidy_columns", "infer_schema_messy", "infer_schema_raw", "numeric_stats_messy", "histogram_messy",
    "duplicate_rows_documents", "category_stats_messy", "correlations", "missing_cells", "apply_impute", "apply_clip",
    "one_hot_infrequent", "category_table", "confusion", "classification_metrics", "roc_auc", "train_test_split", "tune_threshold",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, duck, name):
    found = canonical(queries()[name](spark, FOLDER).toPandas())
    assert found == canonical(duck.execute(oracle_sql()[name]).fetchdf())


def test_entry_gives_a_row_per_column(spark):
    assert entry(spark).count() == 11


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_scans_read_only_the_columns_they_need(spark):
    from colprism.operators.profile import numeric_moments
    df = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    plan = numeric_moments(df, ["l_quantity"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double>" in plan
