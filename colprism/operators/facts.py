"""Per-column facts: the aggregates every later rule reads.

A few scans of the table give one small row per column:

* presence and range from a wide aggregate, cut into chunks of columns (the
  scan is pruned to the chunk, so the bytes read stay the same);
* text shapes and numeric moments from tall (column, value) rows;
* exact distinct counts through narrow digests of the values.

All aggregate partially in each task, so apart from the distinct digests only
a row per column and task is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.functions import fixed
from colprism.functions.columns import (
    PLAIN_NUMBER, as_number, col, digest, nan_to_null, physical, sample_skew, timestamp_of_text,
)

# columns per wide aggregate; more would outgrow what the JIT compiles
CHUNK = 24


def tall(df: DataFrame, cells: dict[str, Column], value: str = "x") -> DataFrame:
    """(at, value) rows for several same-typed columns; ``at`` numbers them.

    Grouping these by ``at`` keeps the generated code the same size however
    many columns there are.
    """
    return df.select(F.posexplode(F.array(*cells.values())).alias("at", value)).where(F.col(value).isNotNull())


def lookup(values: list, at: str = "at") -> Column:
    """A literal list read by position, for per-column constants in a tall frame."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(at))


def _presence(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    """Rows, filled cells and numeric range per column, from one wide aggregate."""
    wide, structs = [F.count(F.lit(1)).alias("rows")], []
    for i, field in fields:
        kind = physical(field.dataType)
        wide.append(F.count(col(field.name)).alias(f"n{i}"))
        ranged = kind in ("integer", "float", "boolean")
        if ranged:
            x = as_number(field.name, kind)
            wide += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        structs.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(field.name).alias("name"),
            F.lit(field.dataType.simpleString()).alias("dtype"), F.lit(kind).alias("physical"),
            F.col("rows").alias("rows"), F.col(f"n{i}").alias("non_null"),
            *[(F.col(f"{p}{i}") if ranged else F.lit(None)).cast("double").alias(a)
              for p, a in (("lo", "low"), ("hi", "high"))]))
    return df.agg(*wide).select(F.inline(F.array(*structs)))


def text_facts(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Boolean words, plain numbers, dates and lengths per string column."""
    trimmed = F.trim(F.col("x"))
    word = (F.length(trimmed) <= 5) & F.lower(trimmed).isin(fixed.BOOLEAN_WORDS)
    return (tall(df, {n: col(n).cast("string") for n in names.values()}).groupBy("at").agg(
        F.bool_and(word).alias("all_words"),
        F.count_if(F.col("x").rlike(PLAIN_NUMBER)).alias("plain_numbers"),
        F.count(timestamp_of_text(F.col("x"))).alias("dates"),
        F.avg(F.length("x")).alias("avg_length"),
        F.max(F.length("x")).cast("bigint").alias("max_length"))
        .withColumn("ordinal", lookup(list(names))).drop("at"))


def number_facts(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Mean, population deviation, corrected skew, zeros and negatives per column."""
    x = F.col("x")
    return (tall(df, cells).groupBy("at").agg(
        F.count(x).alias("values"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), sample_skew(x).alias("skew"),
        F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"))
        .select(lookup(list(cells)).alias("name"), "values", "min", "max", "mean", "std", "skew", "zeros", "negatives"))


def distinct_counts(df: DataFrame, method: str = "exact", columns: list[str] | None = None) -> DataFrame:
    """Distinct values, and the counts of the rarest and commonest, per column.

    Values travel as digests: one 64-bit hash is exact for types of up to
    eight bytes (the hash is a bijection there), strings and larger types
    carry 128 bits. Repeats are combined before the shuffle, so a hot value
    costs one row per task. ``method="approx"`` keeps a sketch per column
    instead and shuffles nothing but sketches.
    """
    df = nan_to_null(df)
    fields = [(i, f) for i, f in enumerate(df.schema.fields)
              if physical(f.dataType) not in ("void", "nested") and (columns is None or f.name in columns)]
    if not fields:
        return df.sparkSession.createDataFrame([], "ordinal int, unique bigint, rarest bigint, commonest bigint")
    if method == "approx":
        hashed = {str(i): F.when(col(f.name).isNotNull(), F.xxhash64(col(f.name))) for i, f in fields}
        # about 0.8 % relative error from a 16 KB sketch per column and task
        return tall(df, hashed).groupBy("at").agg(F.hll_sketch_estimate(F.hll_sketch_agg("x", 14)).alias("unique")).select(
            lookup([i for i, _ in fields]).alias("ordinal"), "unique",
            F.lit(None).cast("bigint").alias("rarest"), F.lit(None).cast("bigint").alias("commonest"))

    def short(field: T.StructField) -> bool:
        kind = field.dataType
        return not isinstance(kind, T.StringType) and not (isinstance(kind, T.DecimalType) and kind.precision > 18)

    cells = F.array(*[F.struct(
        F.when(col(f.name).isNotNull(), F.xxhash64(col(f.name))).alias("head"),
        (F.lit(0).cast("bigint") if short(f) else F.xxhash64(F.lit(29), col(f.name))).alias("tail")) for _, f in fields])
    spread = (df.select(F.posexplode(cells).alias("at", "v")).select("at", "v.head", "v.tail").where("head is not null"))
    values = (spread.groupBy("at", "head", "tail").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("ordinal", lookup([i for i, _ in fields])))
    return values.groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("unique"), F.min("n").alias("rarest"), F.max("n").alias("commonest"))


def column_facts(df: DataFrame, moments: bool = False, distinct: str = "exact") -> DataFrame:
    """One row per column: counts, range, lengths, text shape, distinct values.

    Every side of the joins has a row per column, so the broadcasts are
    bounded by the width of the table.
    """
    df = nan_to_null(df)
    fields = list(enumerate(df.schema.fields))
    chunks = [fields[i:i + CHUNK] for i in range(0, len(fields), CHUNK)]
    facts = reduce(DataFrame.unionAll, [_presence(df, c) for c in chunks])
    facts = facts.join(F.broadcast(distinct_counts(df, distinct)), "ordinal", "left")
    texts = {i: f.name for i, f in fields if physical(f.dataType) == "string"}
    empty = df.sparkSession.createDataFrame
    words = text_facts(df, texts) if texts else empty(
        [], "all_words boolean, plain_numbers bigint, dates bigint, avg_length double, max_length bigint, ordinal int")
    facts = facts.join(F.broadcast(words), "ordinal", "left")
    if moments:
        numbers = {f.name: as_number(f.name, physical(f.dataType)) for _, f in fields
                   if physical(f.dataType) in ("integer", "float")}
        found = number_facts(df, numbers) if numbers else empty(
            [], "name string, values bigint, min double, max double, mean double, std double, skew double, zeros bigint, negatives bigint")
        facts = facts.join(F.broadcast(found.drop("values", "min", "max")), "name", "left")
    return (facts.withColumn("unique", F.coalesce("unique", F.lit(0)))
            .withColumn("nulls", F.col("rows") - F.col("non_null")))


def row_digest(df: DataFrame) -> list[Column]:
    """128 bits that identify a row's content, for any column types."""
    parts = []
    for f in df.schema.fields:
        c = col(f.name)
        # maps have no hash in Spark; their JSON text has
        parts.append(F.to_json(c) if "map<" in f.dataType.simpleString() else c)
    return digest(parts)
