"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.functions import fixed

PLAIN_NUMBER = r"^\s*-?\d+\.?\d*\s*$"
PARSABLE_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE_LIKE = r"^\s*(\d{1,4}[-/ ]|[A-Z][a-z]{2,8} \d)"
LEADING_ZERO = r"^-?0\d"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col(quoted(name))


def physical(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.FractionalType):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, T.NullType):
        return "void"
    return "nested"


def physicals(df: DataFrame) -> dict[str, str]:
    return {f.name: physical(f.dataType) for f in df.schema.fields}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere downstream, so turn it into NULL once."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns
    ])


def number_of_text(c: Column) -> Column:
    """The double a trimmed text spells, NULL for anything else."""
    text = F.trim(c)
    return F.when(text.rlike(PARSABLE_NUMBER), text.try_cast("double"))


def timestamp_of_text(c: Column) -> Column:
    """The timestamp a text spells in one of the recognised formats, else NULL.

    Each format is tried only on texts of its shape: a failed parse raises
    and catches an exception inside Spark, which long free text would pay for
    on every row.
    """
    text = F.trim(c)
    parsed = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
        for shape, pattern in fixed.DATE_FORMATS
    ]
    dated = c.rlike(DATE_LIKE)
    return F.when(dated, F.coalesce(*parsed))


def as_number(name: str, kind: str) -> Column:
    """A column as double for statistics: numbers, flags and numeric texts."""
    if kind == "string":
        return number_of_text(col(name))
    if kind == "boolean":
        return col(name).cast("int").cast("double")
    return col(name).cast("double")


def as_timestamp(name: str, kind: str) -> Column:
    if kind == "string":
        return timestamp_of_text(col(name))
    return col(name).cast("timestamp")


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness, NULL below three values or without spread."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both sides are present; NULL without spread."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def digest(columns: list[Column]) -> list[Column]:
    """128 bits over several columns as two longs.

    A NULL leaves a running hash unchanged, so each column is hashed with its
    null flag; the halves differ in seed and in column order.
    """
    forward, backward = [F.lit(11)], [F.lit(29)]
    for c in columns:
        forward += [c, c.isNull()]
    for c in reversed(columns):
        backward += [c.isNull(), c]
    return [F.xxhash64(*forward), F.xxhash64(*backward)]


def cell_text(name: str, dtype: T.DataType) -> Column:
    """One value as text, for tables that hold values of several columns."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col(name), "yyyy-MM-dd HH:mm:ss")
    return col(name).cast("string")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
