import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colprism.functions import fixed
from colprism.operators import profile as P
from colprism.operators.facts import column_facts
from colprism.operators.schema import infer_schema, kinds_by_name
from colprism.operators.sampling import sample_frame
from sample_tables import TREES, to_spark

# the decision list, a case or more per rule: values, their type, the kind they have as they stand and the kind once folded
RULES = {
    "no values": ([None, None, None], "string", "empty", "empty"),
    "only not-a-number": ([float("nan")] * 3, "double", "empty", "empty"),
    "one value besides gaps": ([None, "oak", "oak"], "string", "constant", "constant"),
    "one number": ([2.5] * 4, "double", "constant", "constant"),
    "two truth values": ([True, False, True], "boolean", "boolean", "boolean"),
    "truth values with gaps": ([True, None, False], "boolean", "boolean", "boolean"),
    "moments": ([f"2021-03-{d:02d} 10:00:00" for d in range(1, 20)], "timestamp", "datetime", "datetime"),
    "zero and one": ([0, 1, 1, 0, 0], "bigint", "boolean", "boolean"),
    "zero and one as fractions": ([0.0, 1.0, 1.0], "double", "boolean", "boolean"),
    "two other numbers": ([3, 4, 4], "bigint", "categorical", "categorical"),
    "21 whole numbers, all different": ([7 * k for k in range(21)], "bigint", "identifier", "identifier"),
    "20 whole numbers, all different": ([7 * k for k in range(20)], "bigint", "numeric", "numeric"),
    "all different but for a gap": ([*range(30), None], "bigint", "numeric", "numeric"),
    "ten whole numbers": ([k % 10 for k in range(40)], "bigint", "categorical", "categorical"),
    "eleven whole numbers": ([k % 11 for k in range(40)], "bigint", "numeric", "numeric"),
    "fractions, all different": ([k / 8 for k in range(64)], "double", "numeric", "numeric"),
    "words of truth": (["T", " f "] * 6, "string", "boolean", "categorical"),
    "two other words": (["up", "down"] * 9, "string", "categorical", "categorical"),
    "days in words": ([f"{d} March 2022" for d in range(1, 29)], "string", "datetime", "datetime"),
    "days, and fewer than 85 % of them": ([f"2022-03-{d:02d}" for d in range(1, 21)] + [f"soon{k}" for k in range(8)], "string", "identifier", "identifier"),
    "numbers written out": ([f"{k}.25" for k in range(90)], "string", "identifier", "identifier"),
    "half as many values as rows": ([f"v{k // 2}" for k in range(60)], "string", "categorical", "categorical"),
    "more values than half the rows": ([f"v{k}" for k in range(31)] * 1 + ["v0"] * 29, "string", "identifier", "identifier"),
    "long texts": (["the weather on day %d was much as it had been before" % k for k in range(40)], "string", "text", "text"),
}


@pytest.mark.parametrize("rule", RULES)
def test_every_rule_of_the_decision_list(spark, rule):
    values, kind, plain, folded = RULES[rule]
    df = spark.createDataFrame([(v,) for v in values], f"v {'string' if kind == 'timestamp' else kind}").selectExpr(f"cast(v AS {kind}) AS v")
    assert kinds_by_name(infer_schema(df)) == {"v": plain}
    assert kinds_by_name(infer_schema(df, folded=True)) == {"v": folded}


def test_one_table_has_all_kinds_and_a_reason_for_each(schema):
    found = kinds_by_name(schema)
    assert set(found.values()) == {"identifier", "categorical", "numeric", "datetime", "text", "constant", "empty", "boolean"}
    assert [c for c in found if found[c] == "numeric"] == ["height", "age", "harvest"]
    assert (found["tree"], found["sweet"], found["buyer"]) == ("identifier", "boolean", "empty")
    assert schema.where("length(trim(reason)) > 0").count() == len(found)


def test_a_sample_tells_the_kinds_of_the_whole(spark, trees):
    eightfold = to_spark(spark, pd.concat([trees] * 8, ignore_index=True))
    whole = kinds_by_name(infer_schema(eightfold))
    assert [kinds_by_name(infer_schema(eightfold, sample_rows=n)) for n in (400, 2000)] == [whole, whole]


def test_sample_has_the_exact_size_and_repeats(spark, frame):
    a, b = sample_frame(frame, 100), sample_frame(frame, 100)
    assert a.count() == 100
    assert {r["tree"] for r in a.collect()} == {r["tree"] for r in b.collect()}


def test_copies_of_one_row_do_not_break_the_sample(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    assert sample_frame(df, 500).count() == 500


def test_results_do_not_depend_on_partitions(frame):
    one = {r["name"]: r for r in column_facts(frame.coalesce(1), moments=True).collect()}
    many = {r["name"]: r for r in column_facts(frame.repartition(13), moments=True).collect()}
    for name, row in one.items():
        for key in row.asDict():
            a, b = row[key], many[name][key]
            assert a == b or a == pytest.approx(b, rel=1e-9)


@pytest.fixture(scope="module")
def report(frame):
    return P.profile(frame)


NUMBERS = ("height", "age", "harvest")


def test_moments_quartiles_and_fences_equal_pandas(report, trees):
    stats = report.columns.where("kind = 'numeric'").toPandas().set_index("name")
    assert sorted(stats.index) == sorted(NUMBERS) and report.rows == TREES
    values = trees[list(NUMBERS)].astype(float)
    cuts = values.quantile([0.25, 0.5, 0.75]).T
    reach = 1.5 * (cuts[0.75] - cuts[0.25])
    beyond = values.lt(cuts[0.25] - reach) | values.gt(cuts[0.75] + reach)
    want = pd.DataFrame({"q1": cuts[0.25], "median": cuts[0.5], "q3": cuts[0.75], "std": values.std(ddof=0), "skew": values.skew(),
                         "outliers": beyond.sum(), "mean": values.mean()})
    pd.testing.assert_frame_equal(stats.loc[list(NUMBERS), list(want.columns)].astype(float), want.astype(float), check_names=False)


def test_bins_hold_every_row_where_numpy_puts_it(report, trees):
    bins = report.histogram.orderBy("name", "bin").toPandas().groupby("name")["count"].apply(list)
    for name in NUMBERS:
        want, _ = np.histogram(trees[name].astype(float), min(20, trees[name].nunique()))
        assert bins[name] == want.tolist() and sum(bins[name]) == TREES


def test_shares_of_top_values_make_a_whole(report, trees):
    found = {r["value"]: r["pct"] for r in report.top_values.where("name = 'variety'").collect()}
    assert sum(found.values()) == pytest.approx(100)
    want = trees["variety"].value_counts(normalize=True) * 100
    assert found == pytest.approx(want.round(2).to_dict(), abs=0.01)


def test_planted_correlation_and_faults_are_reported(report):
    assert ("height", "harvest") in {(r["a"], r["b"]) for r in report.correlations.collect()}
    assert {r["column"] for r in report.warnings.collect()} >= {"buyer", "slope", "tree"}


def test_many_columns_correlate_through_blocks_as_in_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(400, 7)) + 1e6, columns=list("abcdefg"))
    pdf["g"] = pdf["a"] * 0.7 + pdf["g"] * 0.3
    pdf.loc[rng.random(400) < 0.2, "b"] = np.nan
    want = pdf.corr()
    for r in P.correlations(spark.createDataFrame(pdf), list("abcdefg"), floor=0.0).collect():
        assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-6)


def test_null_position_matters_for_duplicates(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), ("b", "b")], "x string, y string")
    assert P.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_few_rows_and_nested_columns_do_not_fail(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "a int, v array<double>")
    found = P.profile(df)
    assert found.kinds["v"] == fixed.NESTED_KIND
    assert "only 2 rows" in " ".join(r["issue"] for r in found.warnings.collect())
