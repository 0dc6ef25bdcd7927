"""Helpers that several operators share: saved tables, checked broadcasts, grouped tasks, components."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprism.session import scratch_path

# a side of a join is broadcast only if it has at most so many narrow rows
BROADCAST_ROWS = 2_000_000


_sent: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends this library's modules to the executors, once per application, so that their tasks can import them."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top, folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tempfile.mkdtemp()
    for package in ("colprism", "llm"):
        shutil.copytree(os.path.join(top, package), os.path.join(folder, "modules", package),
                        ignore=lambda d, names: [n for n in names if n == "__pycache__"])
    context.addPyFile(shutil.make_archive(os.path.join(folder, "colprism_llm"), "zip", os.path.join(folder, "modules")))
    _sent.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once into the cluster's shared folder and reads it from there on."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that a table does not have: ``name``, or more underscores before it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a narrow table for broadcast after counting it; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def by_group(df: DataFrame, keys: list[str], sort: list[str], act: Callable[[pa.Table], pa.Table | None],
             schema: str) -> DataFrame:
    """Calls ``act`` on the rows of every key, many keys in a task.

    Keys must have a bounded number of rows: callers split large groups first.
    """
    return acted(df.repartition(*keys), keys, sort, act, schema)


def acted(df: DataFrame, keys: list[str], sort: list[str], act: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """The same where the rows of a key already stand in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            if rest.num_rows < 2000 and rest.nbytes < 32 << 20:
                continue
            cuts = _cuts(rest, keys)
            if len(cuts) > 1:
                yield from _acted(rest.slice(0, cuts[-1]), cuts[:-1], act)
                rest = rest.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from _acted(rest, _cuts(rest, keys), act)

    return df.sortWithinPartitions(*keys, *sort).mapInArrow(run, schema)


def _cuts(rows: pa.Table, keys: list[str]) -> list[int]:
    changes = np.zeros(max(0, rows.num_rows - 1), bool)
    for key in keys:
        values = rows.column(key).to_numpy()
        changes |= values[1:] != values[:-1]
    return [0, *(np.flatnonzero(changes) + 1).tolist()]


def _acted(rows: pa.Table, cuts: list[int], act) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    made = [out for a, b in zip(cuts, [*cuts[1:], rows.num_rows]) if (out := act(rows.slice(a, b - a))) is not None]
    if made:
        yield from pa.concat_tables(made).combine_chunks().to_batches()


def linked(close: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph with this square boolean matrix, in whole rows at a time."""
    n = len(close)
    left = np.ones(n, bool)
    kept = []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed]
        while front:
            at = front.pop()
            new = np.flatnonzero(close[at] & left)
            left[new] = False
            kept += [(at, int(x)) for x in new]
            front += new.tolist()
    return kept


def _sum(links: DataFrame) -> tuple:
    """Tells two sets of links apart."""
    code = F.xxhash64("hi", "lo")
    return tuple(links.agg(F.count("*"), F.bit_xor(code), F.sum(code.cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it reaches.

    Large-star and small-star rounds: every round replaces links by links to
    smaller nodes, until nothing changes. A round is two joins with minima that
    are combined before the shuffle, so a node with many links is no hot task.
    """
    links = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                  .distinct(), "links")
    known = _sum(links)
    while True:
        both = links.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(
            links.select("lo", "hi"))
        # large star: neighbours above a node link to its smallest neighbour
        low = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = (both.join(low, "node").where("other > node")
                 .select(F.col("other").alias("hi"), F.col("low").alias("lo")).distinct())
        # small star: a node and its neighbours below it link to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = (large.join(least, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("low").alias("lo"))
                 .where("hi <> lo").distinct())
        after = saved(small, "links")
        now = _sum(after)
        if now == known:
            roots = after.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
            return roots.union(after.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        known = now
        links = after
