"""Row samples: an exact number of rows, the same ones every time.

A row's key is a 128-bit hash of its content, and its draw a hash of key, number
among equal rows, and seed. Drawing looks at keys alone: they are counted, the
draws of all copies compared with a cut, and the table is filtered by its draws
where it lies. Only rows that have equals are joined, with the keys that were
chosen among those. ``rule`` names the hash: ``"xxhash"`` by default, ``"md5"``
for draws that any other engine can repeat (the key is the MD5 of all values as
text, the draw the first 52 bits of the MD5 of key, number and seed).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.functions.columns import col, digest
from colprism.operators.ranks import order_values
from colprism.session import stable

KEY, COPIES = ["__key", "__key_2"], "__copies"
# copies of one row that a task draws for
PIECE = 1 << 20
# keys of repeated rows that may be broadcast
BROADCAST_KEYS = 1_000_000


def _text(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, T.BinaryType):
        return F.hex(col(c))
    return F.to_json(F.struct(col(c))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else col(c).cast("string")


def with_key(df: DataFrame, rule: str = "xxhash") -> DataFrame:
    """Adds 128 bits, as two numbers, that tell rows of different content apart whatever the order of the columns."""
    names = sorted(df.columns)
    if rule == "md5":
        texts = [_text(df, c) for c in names]
        code = F.md5(F.concat(F.lit(""), *[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))
        halves = [F.conv(F.substring(code, at, 16), 16, -10).cast("bigint") for at in (1, 17)]
    else:
        # maps have no hash
        halves = digest([_text(df, c) if "map<" in df.schema[c].dataType.simpleString() else col(c) for c in names])
    return df.withColumns(dict(zip(KEY, halves)))


def draw(copy: Column, seed: int, rule: str = "xxhash") -> Column:
    """A number in [0, 1) from a row's key."""
    if rule == "md5":
        key = F.lower(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in KEY]))
        bits = F.substring(F.md5(F.concat_ws(":", key, copy.cast("string"), F.lit(str(seed)))), 1, 13)
        return F.conv(bits, 16, 10).cast("bigint") / F.lit(float(2 ** 52))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *KEY, copy.cast("bigint")), 12) / F.lit(float(2 ** 52))


def _small(keys: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(keys) if rows <= BROADCAST_KEYS else keys


def with_draw(df: DataFrame, out: str, seed: int = 0, rule: str = "xxhash") -> DataFrame:
    """Adds a drawn number per row; equal rows get different ones.

    Of equal rows one is kept and written out as often as it stood there, so a
    row that fills much of the table is no hot group.
    """
    keyed = with_key(df, rule)
    repeated = stable(keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias(COPIES)).where(F.col(COPIES) > 1))
    many = repeated.count()
    first = F.lit(0).cast("bigint")
    if not many:
        return keyed.withColumn(out, draw(first, seed, rule)).drop(*KEY)
    found = keyed.join(_small(repeated, many), KEY, "left")
    alone = found.where(f"{COPIES} IS NULL").withColumn("__copy", first)
    again = found.where(f"{COPIES} IS NOT NULL").dropDuplicates(KEY).withColumn(
        "__copy", F.explode(F.sequence(first, F.col(COPIES) - 1)))
    return alone.unionByName(again).withColumn(out, draw(F.col("__copy"), seed, rule)).drop(*KEY, COPIES, "__copy")


def _drawn(keyed: DataFrame, limit: float, seed: int, rule: str) -> DataFrame:
    """(key, copies, draw) of every copy whose draw is below ``limit``."""
    counts = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias(COPIES))
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(COPIES) - 1) / PIECE)))
    few = counts.where(F.col(COPIES) <= PIECE).withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(COPIES) - 1)))
    first = F.col("__piece") * PIECE
    many = (counts.where(F.col(COPIES) > PIECE).withColumn("__piece", piece).repartition(*KEY, "__piece")
            .withColumn("__copy", F.explode(F.sequence(first, F.least(first + PIECE, F.col(COPIES)) - 1))).drop("__piece"))
    return few.unionByName(many).select(*KEY, COPIES, draw(F.col("__copy"), seed, rule).alias("__draw")).where(F.col("__draw") < limit)


def _cut(drawn: DataFrame, found: int, rows: int, low: float, limit: float) -> float:
    """The draw of rank ``rows``: gathered from the few draws between ``low`` and ``limit``, unless it lies below."""
    near = sorted(r[0] for r in drawn.where(F.col("__draw") >= low).select("__draw").collect())
    if found - len(near) < rows:
        return near[rows - 1 - (found - len(near))]
    return order_values(drawn, {"d": F.col("__draw")}, {"d": [rows - 1]}, {"d": (found, 0.0, limit)})[("d", rows - 1)]


def sample_frame(df: DataFrame, rows: int | None, seed: int = 0, rule: str = "xxhash") -> DataFrame:
    """All rows if there are few, else exactly ``rows`` of them, written once."""
    if rows is None:
        return df
    total = df.count()
    if total <= rows:
        return df
    if rows <= 0:
        return df.limit(0)
    keyed = with_key(df, rule)
    # draws lie within this of their mean but for a chance of less than 1e-12; then the limit is raised
    spread = 8 * math.sqrt(rows) + 64
    limit, found = 0.0, 0
    while found < rows:
        limit = min(1.0, max(2 * limit, (rows + spread) / total))
        drawn = stable(_drawn(keyed, limit, seed, rule))
        found = drawn.count()
    cut = _cut(drawn, found, rows, max(0.0, (rows - spread) / total), limit)
    several = drawn.where((F.col("__draw") <= cut) & (F.col(COPIES) > 1)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("__taken"))
    many = several.count()
    out = keyed.where(draw(F.lit(0), seed, rule) <= cut)
    if many:
        # a repeated row stands as often as its copies were drawn
        again = keyed.join(_small(several, many), KEY).dropDuplicates(KEY).withColumn(
            "__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__taken")))).select(keyed.columns)
        out = out.join(_small(several, many), KEY, "left_anti").select(keyed.columns).unionByName(again)
    return stable(out.drop(*KEY))


def cap_rows(df: DataFrame, max_rows: int | None, seed: int = 0, rule: str = "xxhash") -> tuple[DataFrame, bool]:
    """At most ``max_rows`` rows, and whether any were left out."""
    if max_rows is None:
        return df, False
    capped = sample_frame(df, max_rows, seed, rule)
    return capped, capped is not df
