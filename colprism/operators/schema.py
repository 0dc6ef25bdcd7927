"""What every column means: one of eight kinds, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprism.functions import fixed
from colprism.operators.facts import column_facts
from colprism.operators.sampling import sample_frame


def _number(c: Column) -> Column:
    return F.format_number(c, 0)


def check_numeric() -> Column:
    """Kind and reason of a numeric column."""
    unique, non_null, rows = F.col("unique"), F.col("non_null"), F.col("rows")
    # an integer column with gaps is a float to the rules, as it is to pandas
    whole = (F.col("physical") == "integer") & (F.col("nulls") == 0)
    flags = (unique == 2) & (F.col("low") == 0) & (F.col("high") == 1)
    return (
        F.when(flags, _pair("boolean", F.lit("only 0 and 1")))
        .when(whole & (unique == non_null) & (rows > 20), _pair("identifier", F.lit("each row has a different integer")))
        .when(whole & (unique <= 10), _pair("categorical", F.format_string("integer with only %d different values", unique)))
        .otherwise(_pair("numeric", F.concat(_number(unique), F.lit(" different numeric values"))))
    )


def check_text() -> Column:
    """Kind and reason of a string column that was not folded to a category."""
    unique, non_null = F.col("unique"), F.col("non_null")
    length = F.col("avg_length")
    return (
        F.when((unique <= 2) & F.col("all_words"), _pair("boolean", F.lit("reads as true/false")))
        .when(detect_dates(), _pair("datetime", F.lit("date-time value")))
        .when((unique / non_null <= 0.5) & (unique <= 200), _pair("categorical", F.concat(
            _number(unique), F.lit(" different values in "), _number(non_null), F.lit(" rows"))))
        .when(length >= fixed.TEXT_LENGTH, _pair("text", F.format_string(
            "free text, about %d characters long", F.floor(length))))
        .otherwise(_pair("identifier", F.concat(_number(unique), F.lit(" different values, almost one per row"))))
    )


def detect_dates() -> Column:
    """Most values parse as dates, and they are not all plain numbers."""
    return ((F.col("plain_numbers") < F.col("non_null"))
            & (F.col("dates") / F.col("non_null") >= fixed.DATE_SHARE))


def _pair(kind: str, reason: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))


def column_kind(folded: bool) -> Column:
    """The decision list over a row of column facts."""
    unique, rows, kind = F.col("unique"), F.col("rows"), F.col("physical")
    category = _pair("categorical", F.concat(_number(unique), F.lit(" different values")))
    folds = folded_rule() if folded else F.lit(False)
    return (
        F.when(F.col("non_null") == 0, _pair("empty", F.lit("no value is available")))
        .when(kind == "nested", _pair(fixed.NESTED_KIND, F.lit("nested values are not analysed")))
        .when(unique == 1, _pair("constant", F.lit("only one distinct value")))
        # a flag column with gaps is an object column to pandas and folds like a string
        .when((kind == "boolean") & (F.col("nulls") == 0), _pair("boolean", F.lit("stored as boolean")))
        .when(kind == "datetime", _pair("datetime", F.lit("stored as date time")))
        .when(folds & kind.isin("string", "boolean"), category)
        .when(kind == "boolean", _pair("boolean", F.lit("reads as true/false")))
        .when(kind.isin("integer", "float"), check_numeric())
        .otherwise(check_text())
    )


def folded_rule() -> Column:
    """A repeated string column that ingest turns into a category."""
    unique, rows = F.col("unique"), F.col("rows")
    return (unique <= fixed.FOLD_MAX) & (unique <= rows * fixed.FOLD_RATIO)


def fold_categories(df: DataFrame) -> DataFrame:
    """Which string columns repeat enough to be categories: name, unique, folded."""
    facts = column_facts(df)
    return (facts.where(F.col("physical") == "string")
            .select("ordinal", "name", "unique", folded_rule().alias("folded")))


def with_kinds(facts: DataFrame, folded: bool) -> DataFrame:
    return (facts.withColumn("_found", column_kind(folded))
            .withColumn("kind", F.col("_found.kind")).withColumn("reason", F.col("_found.reason"))
            .withColumn("modelable", F.col("kind").isin(fixed.MODELABLE)).drop("_found"))


def infer_schema(df: DataFrame, folded: bool = False, sample_rows: int | None = None,
                 distinct: str = "exact", facts: DataFrame | None = None) -> DataFrame:
    """Kind, reason and modelable flag for every column, a row per column.

    ``folded=True`` after ingest (repeated strings count as categories at
    once), ``False`` on a raw table. Exact over the whole table by default;
    ``sample_rows`` bounds the rows looked at, ``distinct="approx"`` avoids
    the shuffle of distinct values. ``facts`` are the table's own with their
    kinds, if they are known from elsewhere.
    """
    if facts is not None:
        return facts.select("ordinal", "name", "dtype", "kind", "reason", "modelable")
    facts = column_facts(sample_frame(df, sample_rows), distinct=distinct)
    if sample_rows is not None:
        # the identifier rule looks at the length of the whole table
        facts = facts.withColumn("rows", F.greatest("rows", F.lit(df.count())))
    return with_kinds(facts, folded).select("ordinal", "name", "dtype", "kind", "reason", "modelable")


def kinds_by_name(schema: DataFrame) -> dict[str, str]:
    return {r["name"]: r["kind"] for r in schema.select("name", "kind").collect()}


def columns_of_kind(schema: DataFrame, *wanted: str) -> DataFrame:
    return schema.where(F.col("kind").isin(*wanted)).select("ordinal", "name", "kind")


def suggest_targets(schema: DataFrame, limit: int = 20) -> DataFrame:
    """Columns worth offering as a target, most likely first."""
    order = (F.when(F.col("kind") == "boolean", 0).when(F.col("kind") == "categorical", 1)
             .when(F.col("kind") == "numeric", 2).when(F.col("kind") == "datetime", 4))
    return (schema.where(order.isNotNull()).orderBy(order, "ordinal").limit(limit)
            .select("name", "kind"))


def type_composition(schema: DataFrame) -> DataFrame:
    """Columns per kind, in the order of the legend."""
    position = F.array_position(F.array(*[F.lit(k) for k in fixed.KIND_ORDER]), F.col("kind"))
    return schema.groupBy("kind").agg(F.count(F.lit(1)).alias("count")).orderBy(position)


def usable_column_count(schema: DataFrame) -> DataFrame:
    return schema.agg(F.count_if("modelable").alias("usable"), F.count(F.lit(1)).alias("columns"))


def search_columns(schema: DataFrame, stats: DataFrame | None = None, text: str = "",
                   kinds: list[str] | None = None, sort: str = "index", descending: bool = False) -> DataFrame:
    """The column catalogue: name contains, kind filter, sorted, ties by position."""
    table = schema if stats is None else schema.join(
        stats.select("name", "missing_pct", "unique_pct"), "name", "left")
    needle = text.strip().lower()
    if needle:
        table = table.where(F.lower("name").contains(needle))
    if kinds:
        table = table.where(F.col("kind").isin(kinds))
    keys = {
        "index": F.col("ordinal"),
        "name": F.lower("name"),
        "kind": F.array_position(F.array(*[F.lit(k) for k in fixed.KIND_ORDER]), F.col("kind")),
    }
    if stats is not None:
        keys["missing"] = F.coalesce("missing_pct", F.lit(-1.0))
        keys["unique"] = F.coalesce("unique_pct", F.lit(-1.0))
    key = keys[sort]
    return table.orderBy(key.desc() if descending else key.asc(), "ordinal")
