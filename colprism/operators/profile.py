"""Profile of a table: statistics by kind, duplicates, correlations, warnings.

Small facts (a row per column) are pinned on the driver between passes, so
their values enter the next scan as literals instead of through joins.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colprism.functions import fixed
from colprism.functions.columns import (
    as_number, as_timestamp, cell_text, col, finite, nan_to_null, pearson, physicals,
)
from colprism.operators.facts import column_facts, lookup, number_facts, row_digest, tall
from colprism.operators.ranks import quantiles
from colprism.operators.sampling import sample_frame
from colprism.operators.schema import with_kinds
from colprism.session import pin

QUARTILES = [0.25, 0.5, 0.75]
# more numeric columns than this: correlation sums come from blocked matrix products
WIDE_CORRELATION = 4


# ---------------------------------------------------------------- whole table

def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row. Shuffles a digest per distinct row."""
    df = nan_to_null(df)
    head, tail = row_digest(df)
    copies = df.select(head.alias("head"), tail.alias("tail")).groupBy("head", "tail").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def missing_cells(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.sum("nulls").alias("missing_cells"), F.sum("rows").alias("cells"),
        (F.try_divide(F.sum("nulls"), F.sum("rows")) * 100).alias("missing_cells_pct"))


def column_report(facts: DataFrame) -> DataFrame:
    """Missing share and distinct values of every column."""
    return facts.select(
        "ordinal", "name", "dtype", "rows",
        (F.col("nulls") / F.greatest("rows", F.lit(1)) * 100).alias("missing_pct"),
        "unique", (F.col("unique") / F.greatest("non_null", F.lit(1)) * 100).alias("unique_pct"))


# -------------------------------------------------------------------- numbers

def _number_exprs(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    kinds = physicals(df)
    return {c: finite(as_number(c, kinds[c])) for c in columns}


def numeric_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range, mean, population deviation, bias-corrected skew, zero and negative shares."""
    found = number_facts(nan_to_null(df), _number_exprs(df, columns))
    return found.select("name", "values", "min", "max", "mean", "std", "skew",
                        (F.col("zeros") / F.col("values") * 100).alias("zeros_pct"),
                        (F.col("negatives") / F.col("values") * 100).alias("negative_pct"))


def quartiles(df: DataFrame, columns: list[str],
              ranges: dict[str, tuple[int, float, float]] | None = None) -> dict[str, list[float | None]]:
    """Exact quartiles per column, as plain numbers (three per column).

    ``ranges`` holds (non-null count, min, max) per column when known.
    """
    df = nan_to_null(df)
    return quantiles(df, _number_exprs(df, columns), QUARTILES, ranges)


def _fences(q: list[float]) -> tuple[float, float]:
    spread = q[2] - q[0]
    return q[0] - 1.5 * spread, q[2] + 1.5 * spread


def iqr_outliers(df: DataFrame, columns: list[str], quartiles_of: dict | None = None) -> DataFrame:
    """Values outside the 1.5 x IQR fences: count and share per column."""
    df = nan_to_null(df)
    known = quartiles_of or quartiles(df, columns)
    columns = [c for c in columns if known[c][0] is not None]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "name string, q1 double, median double, q3 double, outliers bigint, outliers_pct double")
    fences = [_fences(known[c]) for c in columns]
    x, low, high = F.col("x"), lookup([f[0] for f in fences]), lookup([f[1] for f in fences])
    counted = tall(df, _number_exprs(df, columns)).groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((x < low) | (x > high)).alias("outliers"))
    return counted.select(
        lookup(columns).alias("name"),
        *[lookup([known[c][i] for c in columns]).alias(k) for i, k in enumerate(("q1", "median", "q3"))],
        "outliers", (F.col("outliers") / F.col("n") * 100).alias("outliers_pct"))


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments, quartiles and outliers, a row per numeric column."""
    moments = pin(numeric_moments(df, columns))
    known = dict.fromkeys(columns, (0, None, None)) | {
        r["name"]: (r["values"], r["min"], r["max"]) for r in moments.collect()}
    outliers = iqr_outliers(df, columns, quartiles(df, columns, known))
    return moments.drop("values").join(F.broadcast(pin(outliers)), "name", "left")


def histogram(df: DataFrame, columns: list[str], bins: int = fixed.HISTOGRAM_BINS,
              ranges: dict[str, tuple[float, float, int]] | None = None) -> DataFrame:
    """Equal-width bins per column; the last is closed; empty bins count zero.

    All columns are binned in one scan. ``ranges`` maps a column to its
    (min, max, distinct) when those are already known.
    """
    df = nan_to_null(df)
    exprs = _number_exprs(df, columns)
    if ranges is None:
        found = pin(column_facts(df.select(*[e.alias(c) for c, e in exprs.items()])))
        ranges = {r["name"]: (r["low"], r["high"], r["unique"]) for r in found.collect()}
    columns = [c for c in columns if ranges[c][0] is not None]
    layout, lows, steps, lasts = [], [], [], []
    for name in columns:
        low, high, unique = ranges[name]
        n = min(bins, max(unique, 1))
        if low == high:
            low, high = low - 0.5, high + 0.5
        step = (high - low) / n
        layout += [(name, b, low + b * step, high if b == n - 1 else low + (b + 1) * step) for b in range(n)]
        lows.append(low)
        steps.append(step)
        lasts.append(n - 1)
    frame = df.sparkSession.createDataFrame(layout, "name string, bin int, low double, high double")
    if not columns:
        return frame.withColumn("count", F.lit(0).cast("bigint"))
    x, low, step, last = F.col("x"), F.col("low"), F.col("step"), F.col("last")
    cells = (tall(df, {c: exprs[c] for c in columns})
             .select("at", "x", lookup(lows).alias("low"), lookup(steps).alias("step"), lookup(lasts).alias("last"))
             .select("*", F.least(F.floor((x - low) / step).cast("int"), last).alias("guess")))
    # a value computed into the wrong side of an edge moves over it
    guess = F.col("guess")
    placed = (F.when(x < low + guess * step, guess - 1)
              .when((x >= low + (guess + 1) * step) & (guess < last), guess + 1).otherwise(guess))
    counted = (cells.select("at", placed.alias("bin")).groupBy("at", "bin").agg(F.count(F.lit(1)).alias("count"))
               .select(lookup(columns).alias("name"), "bin", "count"))
    # at most 20 rows per column on either side
    return (frame.join(F.broadcast(counted), ["name", "bin"], "left")
            .withColumn("count", F.coalesce("count", F.lit(0))))


def box_stats(stats: DataFrame) -> DataFrame:
    """Whiskers of a box plot: the fences, kept inside the data."""
    spread = F.col("q3") - F.col("q1")
    return stats.where("q1 is not null and q3 is not null and median is not null").select(
        "name", "min", "q1", "median", "q3", "max",
        F.greatest(F.col("min"), F.col("q1") - 1.5 * spread).alias("low_whisker"),
        F.least(F.col("max"), F.col("q3") + 1.5 * spread).alias("high_whisker"), "mean")


def histogram_range_flag(bins: DataFrame, low: Column, high: Column) -> DataFrame:
    """Marks the bins that overlap a range."""
    return bins.withColumn("inside", (F.col("high") > low) & (F.col("low") < high))


# --------------------------------------------------------------- dates, words

def datetime_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """First, last and span in whole days per datetime column."""
    kinds = physicals(df)
    wide, structs = [], []
    for i, name in enumerate(columns):
        ts = as_timestamp(name, kinds[name])
        wide += [F.min(ts).alias(f"lo_{i}"), F.max(ts).alias(f"hi_{i}")]
        span = F.floor((F.unix_micros(f"hi_{i}") - F.unix_micros(f"lo_{i}")) / F.lit(86_400_000_000.0))
        structs.append(F.struct(F.lit(name).alias("name"), F.col(f"lo_{i}").alias("first"),
                                F.col(f"hi_{i}").alias("last"), span.cast("bigint").alias("span_days")))
    return df.agg(*wide).select(F.inline(F.array(*structs)))


def months(df: DataFrame, columns: list[str], limit: int = fixed.MONTHS) -> DataFrame:
    """Rows per month, the first ``limit`` months present in each column."""
    kinds = physicals(df)
    cells = {c: F.date_format(as_timestamp(c, kinds[c]), "yyyy-MM") for c in columns}
    counted = (tall(df, cells, "month").groupBy("at", "month").agg(F.count(F.lit(1)).alias("count"))
               .select(lookup(columns).alias("name"), "month", "count"))
    first = F.row_number().over(Window.partitionBy("name").orderBy("month"))
    return counted.withColumn("_at", first).where(F.col("_at") <= limit).drop("_at")


def month_density(by_month: DataFrame) -> DataFrame:
    """Month counts against the busiest month of the column."""
    peak = F.max("count").over(Window.partitionBy("name"))
    return by_month.withColumn("peak", peak).withColumn("share_of_peak", F.col("count") / F.greatest(peak, F.lit(1)))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (column, value): one scan for all of the columns."""
    df = nan_to_null(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    return (tall(df, {c: cell_text(c, types[c]) for c in columns}, "value")
            .groupBy("at", "value").agg(F.count(F.lit(1)).alias("count"))
            .select(lookup(columns).alias("name"), "value", "count"))


def top_values(df: DataFrame, columns: list[str], limit: int = fixed.TOP_VALUES) -> DataFrame:
    """The commonest values per column with count and share, ties by value.

    Per-column totals and the top cut are partial aggregates, so no task ever
    holds all values of a column.
    """
    counted = value_counts(df, columns)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("neg"), "value"))), 1, limit)
    # first cut inside spread-out parts of a column, then across the parts
    parts = (counted.withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(64)))
             .withColumn("_at", F.row_number().over(
                 Window.partitionBy("name", "_part").orderBy(F.desc("count"), F.asc("value")))))
    totals = counted.groupBy("name").agg(F.sum("count").alias("_total"))
    picked = parts.where(F.col("_at") <= limit).groupBy("name").agg(best.alias("best"))
    return (picked.select("name", F.posexplode("best").alias("rank", "item"))
            .join(F.broadcast(totals), "name")
            .select("name", (F.col("rank") + 1).alias("rank"), F.col("item.value").alias("value"),
                    (-F.col("item.neg")).alias("count"), (-F.col("item.neg") / F.col("_total") * 100).alias("pct")))


def balance(facts: DataFrame) -> DataFrame:
    """Rarest count against commonest count, 1 for a single value."""
    ratio = F.when(F.col("unique") > 1, F.col("rarest") / F.col("commonest")).when(F.col("unique") == 1, F.lit(1.0))
    return facts.select("name", "unique", ratio.alias("balance"))


def top_values_with_other(top: DataFrame, limit: int = 5) -> DataFrame:
    """The leading values plus one row for the share of all others."""
    shown = top.where(F.col("rank") <= limit).select("name", "rank", "value", "pct")
    other = shown.groupBy("name").agg((100 - F.sum("pct")).alias("pct")).where(F.col("pct") > 0.5)
    return shown.unionByName(other.select("name", F.lit(limit + 1).alias("rank"), F.lit("all other values").alias("value"), "pct"))


def text_stats(facts: DataFrame, columns: list[str]) -> DataFrame:
    return facts.where(F.col("name").isin(columns)).select("name", "avg_length", "max_length")


# --------------------------------------------------------------- correlations

def correlations(df: DataFrame, columns: list[str], floor: float = fixed.CORRELATION_FLOOR,
                 limit: int | None = fixed.CORRELATION_PAIRS) -> DataFrame:
    """Pearson r over pairwise-complete rows, each pair once, strongest first."""
    df = nan_to_null(df)
    spark = df.sparkSession
    exprs = _number_exprs(df, columns)
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return spark.createDataFrame([], "a string, b string, r double")
    if len(columns) <= WIDE_CORRELATION:
        named = df.select(*[e.alias(f"x{i}") for i, e in enumerate(exprs.values())])
        wide = named.agg(*[pearson(F.col(f"x{i}"), F.col(f"x{j}")).alias(f"r_{i}_{j}") for i, j in pairs])
        found = wide.select(F.inline(F.array(*[
            F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"r_{i}_{j}").alias("r"),
                     F.lit(i).alias("_i"), F.lit(j).alias("_j")) for i, j in pairs])))
    else:
        found = _blocked_correlations(df, columns, exprs)
    kept = found.where(F.abs("r") >= floor).orderBy(F.abs("r").desc(), "_i", "_j").drop("_i", "_j")
    return kept.limit(limit) if limit else kept


def _blocked_correlations(df: DataFrame, columns: list[str], exprs: dict[str, Column]) -> DataFrame:
    """Pair sums of many columns as matrix products over Arrow batches.

    Each task keeps one set of column-by-column sums whatever its row count,
    and emits it once; values are shifted by the column mean against
    cancellation.
    """
    p = len(columns)
    xs = [f"x{i}" for i in range(p)]
    numbers = df.select(*[e.alias(x) for x, e in zip(xs, exprs.values())])
    centre = [v or 0.0 for v in numbers.agg(*[F.avg(x) for x in xs]).first()]

    def sums(batches):
        n, sx, sxx, sxy = (np.zeros((p, p)) for _ in range(4))
        for pdf in batches:
            m = pdf[xs].to_numpy(dtype="float64")
            seen = ~np.isnan(m)
            v = np.where(seen, m - np.array(centre), 0.0)
            s = seen.astype("float64")
            n += s.T @ s
            sx += v.T @ s
            sxx += (v * v).T @ s
            sxy += v.T @ v
        i, j = np.triu_indices(p, 1)
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "si": sx[i, j], "sj": sx[j, i],
                            "sii": sxx[i, j], "sjj": sxx[j, i], "sij": sxy[i, j]})

    schema = "i int, j int, n double, si double, sj double, sii double, sjj double, sij double"
    total = numbers.mapInPandas(sums, schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])
    cov = F.col("sij") - F.try_divide(F.col("si") * F.col("sj"), F.col("n"))
    va = F.col("sii") - F.try_divide(F.col("si") * F.col("si"), F.col("n"))
    vb = F.col("sjj") - F.try_divide(F.col("sj") * F.col("sj"), F.col("n"))
    names = F.array(*[F.lit(c) for c in columns])
    return total.select(
        F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"),
        F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("r"), F.col("i").alias("_i"), F.col("j").alias("_j"))


def correlation_matrix(pairs: DataFrame, max_columns: int = 14) -> DataFrame:
    """Symmetric matrix of the reported pairs over the first names seen."""
    order: list[str] = []
    rows = pairs.collect()
    for r in rows:
        for name in (r["a"], r["b"]):
            if name not in order and len(order) < max_columns:
                order.append(name)
    mirrored = pairs.select("a", "b", "r").unionAll(pairs.select(F.col("b"), F.col("a"), F.col("r")))
    diagonal = pairs.sparkSession.createDataFrame([(n, n, 1.0) for n in order], "a string, b string, r double")
    return (mirrored.unionAll(diagonal).where(F.col("a").isin(order) & F.col("b").isin(order))
            .groupBy("a").pivot("b", order).agg(F.max("r")).withColumnRenamed("a", "column"))


def correlation_strength(pairs: DataFrame) -> DataFrame:
    return (pairs.withColumn("strength", F.when(F.abs("r") >= 0.8, "strong").otherwise("moderate"))
            .withColumn("sign", F.when(F.col("r") >= 0, "positive").otherwise("negative")))


def related_columns(pairs: DataFrame, name: str) -> DataFrame:
    """The reported pairs that touch one column."""
    return pairs.where((F.col("a") == name) | (F.col("b") == name))


# ------------------------------------------------------------------- missing

def missing_matrix(df: DataFrame, order_by: list[str], rows: int | None = None, max_columns: int = 48) -> DataFrame:
    """Missing flag per cell, at most ``max_columns`` evenly spaced columns.

    Null and the empty string count. With ``rows`` only the leading rows by
    ``order_by``; without, all of them.
    """
    names = df.columns
    if len(names) > max_columns:
        step = len(names) / max_columns
        names = [names[int(i * step)] for i in range(max_columns)]
    head = df.orderBy(*order_by).limit(rows) if rows else df
    return head.select(*[col(c).alias(f"key_{c}") for c in order_by], *[_absent(df, c).alias(c) for c in names])


def _absent(df: DataFrame, name: str) -> Column:
    c = col(name)
    return (c.isNull() | (c == "")) if physicals(df)[name] == "string" else c.isNull()


def missing_rate(df: DataFrame) -> DataFrame:
    """Share of missing cells per column over the whole table."""
    df = nan_to_null(df)
    wide = df.agg(*[F.avg(_absent(df, c).cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"m{i}").alias("rate")) for i, c in enumerate(df.columns)])))


def missing_pattern(df: DataFrame, name: str, order_by: list[str]) -> DataFrame:
    """Missing flags of one column, keyed for row order."""
    return df.select(*[col(c) for c in order_by], _absent(df, name).alias("missing"))


def rank_missing(report: DataFrame, limit: int = 12) -> DataFrame:
    return (report.where(F.col("missing_pct") > 0).orderBy(F.desc("missing_pct"), "ordinal").limit(limit)
            .select("name", "missing_pct"))


def rank_outliers(stats: DataFrame) -> DataFrame:
    """Numeric columns with quartiles, most outliers first."""
    return (stats.where("q1 is not null").orderBy(F.desc_nulls_last("outliers_pct"), "ordinal")
            .select("name", "outliers", "outliers_pct"))


def rank_cardinality(report: DataFrame) -> DataFrame:
    """Columns by distinct share, with the number of high-cardinality categoricals."""
    high = F.count_if((F.col("kind") == "categorical") & (F.col("unique") > fixed.HIGH_CARDINALITY))
    position = F.row_number().over(Window.orderBy(F.desc("unique_pct"), "ordinal"))
    return report.select("name", "kind", "unique", "unique_pct", position.alias("rank"),
                         high.over(Window.partitionBy()).alias("high_cardinality"))


# ------------------------------------------------------------------- warnings

def warnings(stats: DataFrame, rows: int) -> DataFrame:
    """Problems to fix before modelling, a row per (column, issue)."""
    kind = F.col("kind")

    def issue(condition, level, text):
        return F.when(condition, F.struct(F.col("name").alias("column"), F.lit(level).alias("level"), text.alias("issue")))

    found = F.array_compact(F.array(
        issue(kind == "empty", "high", F.lit("column is completely empty")),
        issue(kind == "constant", "medium", F.lit("same value in every row, carries no signal")),
        issue(kind == "identifier", "medium", F.lit("looks like an id, will be excluded from models")),
        issue(F.col("missing_pct") >= fixed.HIGH_MISSING_PCT, "high",
              F.format_string("%.0f%% of values are missing", F.col("missing_pct"))),
        issue((kind == "categorical") & (F.col("unique") > fixed.HIGH_CARDINALITY), "medium",
              F.concat(F.format_number("unique", 0), F.lit(" categories, rare ones will be grouped together"))),
        issue((kind == "numeric") & (F.abs("skew") >= 3), "low", F.lit("heavily skewed, a log transform may help")),
        issue((kind == "numeric") & (F.col("outliers_pct") >= 5), "low",
              F.format_string("%.0f%% of values sit outside the normal range", F.col("outliers_pct"))),
    ))
    per_column = stats.select("ordinal", F.explode(found).alias("w")).select("ordinal", "w.*")
    if rows < fixed.FEW_ROWS:
        whole = stats.sparkSession.createDataFrame(
            [(None, None, "high", "only %d rows, model scores will not be reliable" % rows)],
            "ordinal int, column string, level string, issue string")
        per_column = per_column.unionByName(whole)
    return per_column


def sort_warnings(found: DataFrame) -> DataFrame:
    rank = F.when(F.col("level") == "high", 0).when(F.col("level") == "medium", 1).otherwise(2)
    return found.orderBy(rank, F.asc_nulls_last("ordinal"))


# ------------------------------------------------------------------- assembly

@dataclass
class Profile:
    """The tables of one profile; all but ``columns`` may be empty."""
    rows: int
    sampled_rows: int
    duplicate_rows: int
    missing_cells_pct: float
    columns: DataFrame
    histogram: DataFrame | None = None
    top_values: DataFrame | None = None
    by_month: DataFrame | None = None
    correlations: DataFrame | None = None
    warnings: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)

    def summary(self) -> DataFrame:
        return self.columns.sparkSession.createDataFrame(
            [(self.rows, len(self.kinds), self.sampled_rows, self.duplicate_rows, self.missing_cells_pct)],
            "rows bigint, columns int, sampled_rows bigint, duplicate_rows bigint, missing_cells_pct double")


def column_stats(df: DataFrame, folded: bool = False, distinct: str = "exact",
                 facts: DataFrame | None = None) -> DataFrame:
    """The statistics of every column by kind, a row per column."""
    df = nan_to_null(df)
    facts = pin(with_kinds(column_facts(df, moments=True, distinct=distinct), folded)) if facts is None else facts
    known = {r["name"]: r for r in facts.collect()}
    numeric = [c for c in df.columns if known[c]["kind"] == "numeric"]
    temporal = [c for c in df.columns if known[c]["kind"] == "datetime"]
    isnum, isword = F.col("kind") == "numeric", F.col("kind").isin("categorical", "boolean", "constant")
    istext, n = F.col("kind") == "text", F.greatest("non_null", F.lit(1))

    texts = [c for c in numeric if known[c]["physical"] == "string"]
    base = facts
    if texts:
        # numbers written as text have their moments only after parsing
        parsed = pin(number_facts(df, _number_exprs(df, texts))).drop("values")
        filled = {"low": "min", "high": "max", **{c: c for c in ("mean", "std", "skew", "zeros", "negatives")}}
        base = facts.alias("f").join(F.broadcast(parsed.alias("p")), F.col("f.name") == F.col("p.name"), "left").select(
            *[F.col(f"f.{c}") for c in facts.columns if c not in filled],
            *[F.coalesce(f"f.{a}", f"p.{b}").alias(a) for a, b in filled.items()])
    stats = base.select(
        "ordinal", "name", "kind", "dtype", "reason", "modelable", "rows",
        (F.col("nulls") / F.greatest("rows", F.lit(1)) * 100).alias("missing_pct"),
        "unique", (F.col("unique") / n * 100).alias("unique_pct"),
        *[F.when(isnum, finite(F.col(a))).alias(b) for a, b in
          (("low", "min"), ("high", "max"), ("mean", "mean"), ("std", "std"), ("skew", "skew"))],
        *[F.when(isnum, F.col(a) / n * 100).alias(b)
          for a, b in (("zeros", "zeros_pct"), ("negatives", "negative_pct"))],
        F.when(isword & (F.col("unique") > 1), F.col("rarest") / F.col("commonest"))
         .when(isword, F.lit(1.0)).alias("balance"),
        F.when(istext, F.col("avg_length")).alias("avg_length"),
        F.when(istext, F.col("max_length")).alias("max_length"))
    if numeric:
        ranges = {r["name"]: (r["non_null"], r["low"], r["high"]) for r in base.collect()}
        plain = all(v[1] is None or math.isfinite(v[1]) and math.isfinite(v[2]) for v in ranges.values())
        outliers = pin(iqr_outliers(df, numeric, quartiles(df, numeric, ranges if plain and not texts else None)))
    else:
        outliers = iqr_outliers(df, [])
    stats = stats.join(F.broadcast(outliers), "name", "left")
    if temporal:
        spans = pin(datetime_stats(df, temporal))
    else:
        spans = df.sparkSession.createDataFrame([], "name string, first timestamp, last timestamp, span_days bigint")
    return stats.join(F.broadcast(spans), "name", "left")


def profile(df: DataFrame, folded: bool = False, sample_rows: int | None = None, distinct: str = "exact") -> Profile:
    """Everything about a table: a handful of scans, small tables out.

    Exact over the whole table by default; ``sample_rows`` bounds the rows.
    Scans that do not need each other run side by side.
    """
    total = df.count()
    view = nan_to_null(sample_frame(df, sample_rows))
    if sample_rows:
        view = view.persist()
    with ThreadPoolExecutor(5) as pool:
        copies = pool.submit(lambda: duplicate_rows(view).first())
        facts = column_facts(view, moments=True, distinct=distinct)
        if sample_rows:
            # kinds look at the length of the whole table, shares at the sample's
            facts = facts.withColumn("sampled", F.col("rows")).withColumn("rows", F.lit(total))
            facts = with_kinds(facts, folded).withColumn("rows", F.col("sampled")).drop("sampled")
        else:
            facts = with_kinds(facts, folded)
        facts = pin(facts)
        known = {r["name"]: r for r in facts.collect()}
        kinds = {c: known[c]["kind"] for c in view.columns}
        of = lambda *k: [c for c in view.columns if kinds[c] in k]
        numeric, words, temporal = of("numeric"), of("categorical", "boolean", "constant"), of("datetime")
        written = any(known[c]["physical"] == "string" for c in numeric)
        ranges = None if written else {c: (known[c]["low"], known[c]["high"], known[c]["unique"]) for c in numeric}
        parts = {
            "columns": lambda: pin(column_stats(view, folded, distinct, facts).orderBy("ordinal")),
            "histogram": lambda: pin(histogram(view, numeric, ranges=ranges)) if numeric else None,
            "correlations": lambda: pin(correlations(view, numeric)) if len(numeric) > 1 else None,
            "top_values": lambda: pin(top_values(view, words)) if words else None,
            "by_month": lambda: pin(months(view, temporal)) if temporal else None,
        }
        running = {name: pool.submit(make) for name, make in parts.items()}
        made = {name: future.result() for name, future in running.items()}
        repeated = copies.result()
    if sample_rows:
        view.unpersist()
    return Profile(
        rows=total, sampled_rows=repeated["rows"], duplicate_rows=repeated["duplicate_rows"],
        missing_cells_pct=missing_cells(facts).first()["missing_cells_pct"], kinds=kinds,
        warnings=pin(warnings(made["columns"], total)), **made)
