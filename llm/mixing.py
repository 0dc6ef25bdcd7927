"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source is a stream: its documents in a shuffled order that depends only
on their content, cut into blocks of B words. Slot i of the mix has the point
frac(i * golden ratio); the point's place among the cumulative target shares
names the slot's source. The k-th slot of a source takes the k-th block of its
stream, starting over at the stream's end. A source is served until its target
is met; its last slot takes the part of a block that is still missing, and a
source that the points served too seldom gets closing slots behind the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import fresh, saved

GOLDEN = 0.6180339887498949
# about so many slots make up a mix of any size; a block holds total / SLOTS words
SLOTS = 1 << 17
# windows and prefix sums are taken over groups of about so many rows
CHUNK = 16_384
CELLS = 4_096

WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """rows: a row per document; sources: a row per source; slots: the schedule, a row per block taken."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """Adds sid, weight, target and cumulative bounds to (source, source_size).

    Weights repeat over the sources in code-point order, null last. The targets
    share the total of all sizes by weight; none exceeds ``most`` times its
    source's size, and what they leave is reshared by weight among the others.
    That is the level at which sum(min(most * size, level * weight)) is the
    total, found from prefix sums in the order of most * size / weight.
    """
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    wide = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    sid = F.row_number().over(whole) - 1
    return (sizes.withColumn("sid", sid.cast("long"))
            .withColumn("weight", F.element_at(listed, (F.col("sid") % len(weights) + 1).cast("int")))
            .withColumn("most", F.col("source_size") * F.lit(float(most)))
            .withColumn("ratio", F.col("most") / F.col("weight"))
            .withColumn("total", F.sum("source_size").over(wide).cast("double"))
            .withColumn("spent", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
            .withColumn("open", F.sum("weight").over(wide) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("level", (F.col("total") - F.col("spent")) / F.col("open"))
            # the first source in this order that its own level does not fill sets the level of all
            .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "sid", "level")))
                        .over(wide)["level"])
            .withColumn("target", F.coalesce(F.least("most", F.col("weight") * F.col("level")), F.col("most")))
            .withColumn("high", F.sum("target").over(Window.orderBy("sid")) / F.greatest(F.sum("target").over(wide), F.lit(1e-9)))
            .withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0.0)))
            .withColumn("want", F.round("target").cast("long"))
            .select("source", "sid", "source_size", "weight", "target", "want", "low", "high"))


def _running(df: DataFrame, group: str, part: str, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over earlier rows of the group; ``part`` cuts groups into bounded ordered pieces."""
    sums = df.groupBy(group, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [group, part])
            .withColumn(out, F.col("_start") + F.col("_inside")).drop("_start", "_inside"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, slots: int = SLOTS, seed: str = "mix",
        key: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """Words taken from every document.

    rows: key, text_hash, source, size, source_size, target, taken. A null or
    empty text has size 0 and is never taken; a null source is a source of its
    own, last in order; null and repeated keys and equal rows are documents of
    their own (equal rows are interchangeable). An empty table gives empty
    results. No document is taken more than ``most`` times over, rounded up.
    """
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long")
    turn = F.md5(F.concat_ws("|", F.lit(seed), docs[key].cast("string"), docs[text]))
    rows = saved(docs.select(docs[key].alias(key), docs[source].alias("source"), size.alias("size"),
                             F.xxhash64(docs[text]).alias("text_hash"), turn.alias("turn")), "mix-sizes")
    sources = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-sources")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    block = max(1, facts.words // slots)
    pieces = max(1, facts.n // CHUNK)

    named = rows.join(F.broadcast(sources) if sources.count() <= CHUNK else sources,
                      rows["source"].eqNullSafe(sources["source"])).drop(rows["source"])
    part = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("double") / float(1 << 32) * pieces)
    placed = _running(named.withColumn("part", part), "sid", "part", ["turn", "text_hash"], "size", "at")

    rounds = F.ceil(F.col("source_size") / block)
    enough = F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size")) * rounds
                    + F.ceil(F.col("want") % F.col("source_size") / block)).otherwise(0)
    served = sources.withColumn("blocks", rounds).withColumn("slots", enough.cast("long"))
    plan = _schedule(docs.sparkSession, served, -(-facts.words // block), block)
    plan = saved(plan, "mix-slots")

    cuts = (placed.where("size > 0")
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block),
                                                      F.floor((F.col("at") + F.col("size") - 1) / block))))
            .withColumn("from", F.greatest(F.col("at") - F.col("block") * block, F.lit(0)))
            .withColumn("to", F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))))
    times = plan.groupBy("sid", "block").agg(F.count(F.when(F.col("words") == F.col("length"), 1)).alias("full"),
                                             F.max(F.when(F.col("words") < F.col("length"), F.col("words"))).alias("cut"))
    part_taken = F.greatest(F.least(F.coalesce("cut", F.lit(0)), F.col("to")) - F.col("from"), F.lit(0))
    taken = F.coalesce(F.col("full") * (F.col("to") - F.col("from")) + part_taken, F.lit(0))
    columns = [key, "text_hash", "source", "size", "source_size", "target"]
    some = (cuts.join(times, ["sid", "block"], "left").groupBy(*columns, "sid", "at")
            .agg(F.sum(taken).alias("taken")).select(*columns, "taken"))
    none = named.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return Mix(some.union(none), sources, plan)


def _schedule(spark, served: DataFrame, n: int, block: int) -> DataFrame:
    """slot, sid, source, rank, block, length of the block and words taken from it."""
    cells = served.where("high > low").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS)))))
    points = (spark.range(n).withColumnRenamed("id", "slot")
              .withColumn("point", (F.col("slot") + 0.5) * GOLDEN % 1)
              .withColumn("cell", F.floor(F.col("point") * CELLS)))
    dealt = (points.join(cells, "cell").where("point >= low and point < high")
             .select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"), F.lit(1).alias("one")))
    ranked = _running(dealt, "sid", "chunk", ["slot"], "one", "rank").select("slot", "sid", "rank")
    got = ranked.groupBy("sid").agg(F.count("*").alias("got"))
    closing = (served.join(got, "sid", "left").where("slots > coalesce(got, 0)")
               .select("sid", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("slots") - 1)).alias("rank"))
               .select((F.col("rank") + n).alias("slot"), "sid", "rank"))
    before = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + F.col("block") * block
    return (ranked.union(closing).join(served, "sid").where("rank < slots")
            .withColumn("block", F.col("rank") % F.col("blocks"))
            .withColumn("length", F.least(F.lit(block), F.col("source_size") - F.col("block") * block))
            .withColumn("words", F.least(F.col("length"), F.col("want") - before))
            .select("slot", "sid", "source", "rank", "block", "length", "words"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words were taken, rounded to whole documents.

    Rows never taken are gone; a row of size 0 is gone. All columns stay.
    """
    rows = mix(docs, key=key, text=text, source=source, **settings).rows
    name, code, origin, taken, nth = (fresh(c, docs.columns) for c in ("_key", "_hash", "_source", "_times", "_time"))
    times = (rows.where("size > 0").groupBy(F.col(key).alias(name), F.col("text_hash").alias(code), F.col("source").alias(origin))
             .agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(taken)).where(F.col(taken) > 0))
    rest = docs.join(times, docs[key].eqNullSafe(times[name]) & docs[source].eqNullSafe(times[origin])
                     & (F.xxhash64(docs[text]) == times[code]))
    return rest.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(taken)))).select(*[docs[c] for c in docs.columns])
