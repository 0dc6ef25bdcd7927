"""Reading files of any supported format into a tidy, typed table."""

from __future__ import annotations

import csv
import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.functions import fixed
from colprism.functions.columns import col, nan_to_null
from colprism.sources.separators import sniff_separator
from colprism.sources.tidy import (
    dates_from_objects, decimals_to_double, numbers_from_text, text_shapes, tidy_columns, typed_text,
)
from colprism.sources.workbooks import read_workbooks

SUPPORTED = sorted(fixed.CSV_SUFFIXES + fixed.WORKBOOK_SUFFIXES + fixed.PARQUET_SUFFIXES + fixed.JSON_SUFFIXES)


class ReadError(ValueError):
    pass


def suffix_of(name: str) -> str:
    """The suffix that decides the reader; a folder may be named like a file."""
    return os.path.splitext(str(name).rstrip("/").lower())[1]


def read_any(spark: SparkSession, path: str, name: str | None = None, nrows: int | None = None,
             sheet: str | int | None = None, multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """A file, folder or glob as (table, one-row meta table).

    Names are repaired, numbers and dates written as text become numbers and
    timestamps. ``name`` overrides the suffix taken from ``path``.
    """
    kind = suffix_of(name or path)
    separator = None
    if kind in fixed.CSV_SUFFIXES:
        separator = sniff_separator(spark, path)
        df = read_csv(spark, path, separator, nrows, multi_line)
    elif kind in fixed.WORKBOOK_SUFFIXES:
        body, header = read_workbooks(spark, path, sheet)
        df = typed_text(tidy_columns(_head(body, nrows), header))
    elif kind in fixed.PARQUET_SUFFIXES:
        df = _repaired(read_parquet(spark, path, nrows))
    elif kind in fixed.JSON_SUFFIXES:
        df = _repaired(read_json(spark, path, kind != ".json", nrows))
    else:
        raise ReadError("cannot read '%s', supported types are %s" % (name or path, ", ".join(SUPPORTED)))
    return df, meta(df, os.path.basename(str(name or path).rstrip("/")), kind.lstrip("."), nrows, separator)


def _head(df: DataFrame, nrows: int | None) -> DataFrame:
    return df.limit(nrows) if nrows else df


def _repaired(df: DataFrame) -> DataFrame:
    df = nan_to_null(decimals_to_double(tidy_columns(df)))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    shapes = text_shapes(df, texts)
    # texts stay text here: unlike CSV and workbook cells they carry a type of their own
    return dates_from_objects(numbers_from_text(df, shapes), {})


def _headers(spark: SparkSession, path: str, separator: str) -> list[tuple[str, list[str], bool]]:
    """(file, names, whether a quoted cell breaks a line) of every file that has lines, by file.

    One scan reads all lines: a cell that opens with a quote and does not close
    on its line marks the file as one that can't be split. A row per file comes back.
    """
    at_start = "(^|%s)" % re.escape(separator)
    closed = at_start + r'\x20*"(?:[^"]|"")*+"(?=\x20*(?:%s|$))' % re.escape(separator)
    opening = at_start + r'\x20*"'
    lines = spark.read.text(path).select(
        "value", "_metadata.file_path", F.regexp_replace("value", closed, "$1").rlike(opening).alias("open"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("nth"))
    # the lowest number of a file's first block is that of its first line
    found = (lines.where("open or nth is not null").groupBy("file_path")
             .agg(F.min(F.when(F.col("nth").isNotNull(), F.struct("nth", "value", "open"))).alias("first"),
                  F.max("open").alias("open")))
    out = []
    for row in sorted(found.collect(), key=lambda r: r["file_path"]):
        file = unquote(row["file_path"])
        if row["first"]["open"]:
            names = [c or "" for c in spark.read.csv(file, sep=separator, quote='"', escape='"', multiLine=True).first()]
        else:
            names = next(csv.reader([row["first"]["value"]], delimiter=separator, skipinitialspace=True), [])
        out.append((file, [n.lstrip("\ufeff").strip() for n in names], row["open"]))
    return out


def read_csv(spark: SparkSession, path: str, separator: str = ",", nrows: int | None = None,
             multi_line: bool | None = None) -> DataFrame:
    """Delimited text with a header line in every file.

    Cells are read as text and typed from their contents. Files of one header
    are read by position, so repeated and blank names cannot shift columns;
    files whose headers differ are aligned by name and number among equal
    names, a column that a file lacks is NULL there. Rows with more cells than
    their header are refused. Files with quoted line breaks are read whole, the
    others stay splittable, unless ``multi_line`` says for all.
    """
    files = _headers(spark, path, separator)
    if not files:
        raise ReadError("'%s' has no rows" % path)
    groups: dict[tuple, list[str]] = {}
    for file, names, broken in files:
        groups.setdefault((tuple(names), broken if multi_line is None else multi_line), []).append(file)
    order = list(dict.fromkeys(key for names, _ in groups for key in _numbered(names)))
    parts = []
    for (names, broken), listed in groups.items():
        cells = [f"_{i}" for i in range(len(names))]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "_wide"]])
        raw = spark.read.csv(path if len(groups) == 1 else listed, schema=schema, sep=separator, header=True, enforceSchema=True,
                             quote='"', escape='"', multiLine=broken, mode="PERMISSIVE")
        at = dict(zip(_numbered(names), cells))
        parts.append(raw.select(*[(F.col(at[key]) if key in at else F.lit(None).cast("string")).alias(f"_{i}")
                                  for i, key in enumerate(order)], "_wide"))
    raw = reduce(DataFrame.unionAll, parts)
    wide = raw.agg(F.count("_wide")).first()[0]
    if wide:
        raise ReadError("'%s' has %d rows with more cells than their header" % (path, wide))
    missing = fixed.MISSING_WORDS
    raw = raw.select(*[F.when(~F.col(c).isin(missing), F.col(c)).alias(c) for c in raw.columns if c != "_wide"])
    return typed_text(tidy_columns(_head(raw, nrows), [name for name, _ in order]))


def _numbered(names: tuple[str, ...]) -> list[tuple[str, int]]:
    """Every name with its number among equal names."""
    return [(name, names[:i].count(name)) for i, name in enumerate(names)]


def read_parquet(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    return _head(spark.read.parquet(path), nrows)


def read_json(spark: SparkSession, path: str, lines: bool = True, nrows: int | None = None) -> DataFrame:
    return _head(spark.read.json(path, multiLine=not lines), nrows)


def meta(df: DataFrame, name: str, fmt: str, nrows: int | None = None, separator: str | None = None) -> DataFrame:
    """Name, format, size and reading options of a table, one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("name"), F.lit(fmt).alias("format"), "rows", F.lit(len(df.columns)).alias("columns"),
        (F.col("rows") >= F.lit(nrows) if nrows is not None else F.lit(False)).alias("truncated"),
        F.lit(separator).cast("string").alias("separator"))


def preview(df: DataFrame, rows: int = 50, order_by: list[str] | None = None) -> DataFrame:
    """The first rows, safe to show: formatted times, no NaN or infinity."""
    if not 1 <= rows <= 1000:
        raise ReadError("a preview has 1 to 1000 rows, not %d" % rows)
    head = df.orderBy(*[col(c) for c in order_by]).limit(rows) if order_by else df.limit(rows)
    shown = []
    for f in head.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        shown.append(c.alias(f.name))
    return head.select(*shown)


def require_rows(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise ReadError("%s has no rows" % name)
    return df
