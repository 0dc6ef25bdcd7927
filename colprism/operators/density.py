"""DBSCAN over a space-partition tree.

Equal points are one spot with a weight. Spots are split along the widest
dimension of their box, ``WAYS`` ways at quantiles, until every leaf has at most
``LEAF`` of them; a node's box and weight are those of the leaves below it. Box
distances decide as much as they can:

* a node wholly within reach of a leaf counts at once with its weight, one out
  of reach not at all, others are opened; the walk of a leaf stops when all its
  spots have ``min_samples``;
* a node no wider than the reach is one cluster as it stands, if it has core
  spots; two such nodes wholly within reach of each other are linked at once.

Only leaves that boxes leave undecided are compared spot by spot, two leaves at
a time, in numpy. So a dense place costs its nodes and not its pairs, no task
holds more than two leaves at once, and the dimensions only decide how much
boxes can tell. Everything is exact: what a box tells rounds as a pair does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.operators.ordering import running_total
from colprism.session import written

WAYS = 8
LEAF = 512
ROOT = 1  # a node's children are node * WAYS to node * WAYS + WAYS - 1


def _power(metric: str):
    return (lambda s, v: s + v) if metric == "manhattan" else (lambda s, v: s + v * v)


def _gap(metric: str, nearest: bool) -> Column:
    """Smallest or largest distance (squared, if Euclidean) of the boxes a_lo..a_hi and b_lo..b_hi."""
    above, below = (("a_lo", "b_hi"), ("b_lo", "a_hi")) if nearest else (("a_hi", "b_lo"), ("b_hi", "a_lo"))
    parts = [F.zip_with(p, q, lambda x, y: x - y) for p, q in (above, below)]
    apart = F.zip_with(*parts, lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), _power(metric))


def _width(metric: str) -> Column:
    return F.aggregate(F.zip_with("lo", "hi", lambda p, q: q - p), F.lit(0.0), _power(metric))


def _within(a: np.ndarray, b: np.ndarray, reach: float, metric: str) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are within reach; terms are added in the order of the dimensions, as box distances are."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        step = a[:, i, None] - b[None, :, i]
        total += np.abs(step) if metric == "manhattan" else step * step
    return total <= reach


def _boxes(rows: DataFrame, by: str, dims: int, *more: Column) -> DataFrame:
    """The box of the column x, or of boxes lo and hi, for every value of ``by``."""
    low, high = ("x", "x") if "x" in rows.columns else ("lo", "hi")
    return rows.groupBy(by).agg(F.array(*[F.min(F.get(low, F.lit(i))) for i in range(dims)]).alias("lo"),
                                F.array(*[F.max(F.get(high, F.lit(i))) for i in range(dims)]).alias("hi"), *more)


def _partitioned(spots: DataFrame, dims: int) -> DataFrame:
    """Spots with their ``leaf``."""
    done = None
    open_ = spots.withColumn("leaf", F.lit(ROOT).cast("bigint"))
    shares = [F.lit(k / WAYS) for k in range(1, WAYS)]
    while True:
        sizes = _boxes(open_, "leaf", dims, F.count(F.lit(1)).alias("n")).withColumn(
            "spread", F.zip_with("lo", "hi", lambda p, q: q - p))
        large = written(sizes.where(F.col("n") > LEAF).select(
            "leaf", (F.array_position("spread", F.array_max("spread")) - 1).cast("int").alias("dim"), "lo", "hi"))
        if large.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        small = open_.join(large.select("leaf"), "leaf", "left_anti")
        done = small if done is None else done.unionByName(small)
        inner = open_.join(large.select("leaf", "dim"), "leaf").withColumn("v", F.get("x", F.col("dim")))
        quantiles = inner.groupBy("leaf").agg(F.percentile_approx("v", F.array(*shares), 2000).alias("q"))
        top, bottom = F.get("hi", F.col("dim")), F.get("lo", F.col("dim"))
        cuts = F.filter(F.array_distinct("q"), lambda c: c < F.col("top"))
        found = written(large.select("leaf", top.alias("top"), bottom.alias("bottom")).join(quantiles, "leaf").select(
            "leaf", F.when(F.size(cuts) > 0, cuts).otherwise(F.array((F.col("top") + F.col("bottom")) / 2)).alias("cuts")))
        child = F.aggregate("cuts", F.lit(0), lambda n, c: n + (F.col("v") > c).cast("int"))
        open_ = written(inner.join(found, "leaf").withColumn("leaf", F.col("leaf") * WAYS + child).select(*spots.columns, "leaf"))


def _ancestors(leaf: Column) -> Column:
    """A node and all nodes above it."""
    bits = int(math.log2(WAYS))
    # the number of binary digits of a node is one more than a multiple of those of a digit of its own
    depth = F.floor((F.length(F.bin(leaf)) - 1) / bits).cast("int")
    return F.transform(F.sequence(F.lit(0), depth), lambda k: F.call_function("shiftright", leaf, (k * bits).cast("int")))


def _tree(leaves: DataFrame, dims: int) -> DataFrame:
    """(node, lo, hi, weight, is_leaf) of every node above or at the leaves (leaf, lo, hi, weight)."""
    every = leaves.select(F.explode(_ancestors(F.col("leaf"))).alias("node"), "lo", "hi", "weight", "leaf")
    return _boxes(every, "node", dims, F.sum("weight").alias("weight"), F.max(F.col("node") == F.col("leaf")).alias("is_leaf"))


def _side(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in nodes.columns])


def _children(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Pairs with every child in place of the node in ``column``."""
    below = nodes.where(f"node > {ROOT}").select(F.shiftright("node", int(math.log2(WAYS))).alias(column), F.col("node").alias("_child"))
    return pairs.join(below, column).drop(column).withColumnRenamed("_child", column)


def _counted(leaves: DataFrame, nodes: DataFrame, reach: float, metric: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(a, sure): weight of nodes wholly within reach of a leaf; and the leaf pairs (a, b) left to compare, of leaves that lack ``least``."""
    a = leaves.where((F.col("weight") < least) | (_width(metric) > reach)).select(
        F.col("leaf").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    inner = _side(nodes, "b")
    todo = written(a.select("a", F.lit(ROOT).cast("bigint").alias("b")))
    sure, open_ = None, None
    while not todo.isEmpty():
        judged = written(todo.join(a, "a").join(inner, "b").where(_gap(metric, True) <= reach)
                        .select("a", "b", "b_weight", "b_is_leaf", (_gap(metric, False) <= reach).alias("inside")))
        told = judged.where("inside").groupBy("a").agg(F.sum("b_weight").alias("sure"))
        sure = written(told if sure is None else sure.unionByName(told).groupBy("a").agg(F.sum("sure").alias("sure")))
        enough = sure.where(F.col("sure") >= least).select("a")
        rest = judged.where("NOT inside").select("a", "b", "b_is_leaf").join(enough, "a", "left_anti")
        leaf_pairs = rest.where("b_is_leaf").select("a", "b")
        open_ = leaf_pairs if open_ is None else open_.unionByName(leaf_pairs)
        todo = written(_children(rest.where("NOT b_is_leaf").select("a", "b"), nodes, "b").select("a", "b"))
    if sure is None:
        # no leaf has to be looked at: each has enough by itself, or there is none
        return a.select("a", F.lit(0).cast("bigint").alias("sure")), todo
    enough = sure.where(F.col("sure") >= least).select("a")
    return sure, written(open_.join(enough, "a", "left_anti"))


def _near(leaves: DataFrame, nodes: DataFrame, reach: float, metric: str) -> DataFrame:
    """Pairs (a, b) of a leaf of ``leaves`` and a leaf of the tree whose boxes come within reach."""
    a, b = _side(leaves.withColumnRenamed("leaf", "node"), "a").select("a", "a_lo", "a_hi"), _side(nodes, "b")
    todo, out = written(a.select("a", F.lit(ROOT).cast("bigint").alias("b"))), None
    while not todo.isEmpty():
        judged = written(todo.join(a, "a").join(b, "b").where(_gap(metric, True) <= reach).select("a", "b", "b_is_leaf"))
        found = judged.where("b_is_leaf").select("a", "b")
        out = found if out is None else out.unionByName(found)
        todo = written(_children(judged.where("NOT b_is_leaf").select("a", "b"), nodes, "b").select("a", "b"))
    return out if out is not None else todo


def _blocks(spots: DataFrame, kept: list[str]) -> DataFrame:
    """One row per leaf: its spots' coordinates and other columns (64-bit numbers), packed in the order of pid."""
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pid").combine_chunks()
        x = rows.column("x").chunk(0).flatten().to_numpy(zero_copy_only=False)
        cells = [x, *(rows.column(c).to_numpy().astype(np.int64) for c in kept)]
        return pa.table([rows.column("leaf").slice(0, 1), pa.array([rows.num_rows], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
                        names=["leaf", "n", "x", *kept])
    fields = ", ".join(["leaf bigint", "n bigint", "x binary", *(f"{c} binary" for c in kept)])
    return written(spots.select("leaf", "x", *kept).groupBy("leaf").applyInArrow(pack, fields))


def _unpacked(rows: dict, side: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    n = rows[f"{side}_n"]
    return (np.frombuffer(rows[f"{side}_x"], float).reshape(n, -1),
            {c[len(side) + 1:]: np.frombuffer(v, np.int64) for c, v in rows.items() if c.startswith(f"{side}_") and c[len(side) + 1:] not in ("n", "x")})


def _compared(pairs: DataFrame, first: DataFrame, second: DataFrame, act, schema: str) -> DataFrame:
    """Calls ``act`` on the two blocks of every pair; a task holds the blocks of a few pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                made = act(_unpacked(row, "a"), _unpacked(row, "b"))
                if made is not None and len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], [f.split()[0] for f in schema.split(", ")])

    renamed = [t.select(*[F.col(c).alias(side if c == "leaf" else f"{side}_{c}") for c in t.columns]) for t, side in ((first, "a"), (second, "b"))]
    return pairs.join(renamed[0], "a").join(renamed[1], "b").drop("a", "b").mapInArrow(run, schema)


def _core_spots(spots: DataFrame, blocks: DataFrame, sure: DataFrame, open_: DataFrame, reach: float, metric: str, least: int) -> DataFrame:
    """Spots (pid, x, leaf, first, core) with whether they have ``least`` points within reach, themselves included."""
    def counts(a, b):
        (x, own), (y, other) = a, b
        n = _within(x, y, reach, metric) @ other["w"]
        return own["pid"][n > 0], n[n > 0]

    near = _compared(open_, blocks, blocks, counts, "pid bigint, near bigint").groupBy("pid").agg(F.sum("near").alias("near"))
    # a leaf no wider than the reach with so much weight was never asked
    dense = F.when(F.col("tight") & (F.col("weight") >= least), F.lit(least)).otherwise(F.coalesce("sure", F.lit(0)))
    told = spots.join(sure.withColumnRenamed("a", "leaf"), "leaf", "left").join(near, "pid", "left")
    return written(told.select("pid", "x", "leaf", "first", "w", (dense + F.coalesce("near", F.lit(0)) >= least).alias("core")))


def _united(close: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over a square boolean matrix."""
    group = np.full(len(close), -1)
    for seed in range(len(close)):
        if group[seed] < 0:
            group[seed], front = seed, [seed]
            while front:
                new = np.flatnonzero(close[front].any(axis=0) & (group < 0))
                group[new], front = seed, new.tolist()
    return group


def _represented(core: DataFrame, tight: DataFrame, reach: float, metric: str) -> DataFrame:
    """Core spots with ``rep``: one spot for all of a tight node, or of those a leaf links by itself."""
    tops = core.select("leaf").distinct().select("leaf", F.explode(_ancestors(F.col("leaf"))).alias("node")).join(tight, "node")
    top = tops.groupBy("leaf").agg(F.min("node").alias("top"))
    placed = core.join(top, "leaf", "left")
    named = placed.where("top IS NOT NULL")
    reps = named.groupBy("top").agg(F.min("pid").alias("rep"))
    whole = named.join(reps, "top").select("pid", "x", "leaf", "rep")

    def local(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pid").combine_chunks()
        pid = rows.column("pid").to_numpy()
        x = rows.column("x").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(pid), -1)
        return rows.append_column("rep", pa.array(pid[_united(_within(x, x, reach, metric))]))

    rest = placed.where("top IS NULL").select("pid", "x", "leaf")
    alone = rest.groupBy("leaf").applyInArrow(local, T.StructType([*rest.schema.fields, T.StructField("rep", T.LongType())]))
    return written(whole.unionByName(alone))


def _links(reps: DataFrame, nodes: DataFrame, tight: DataFrame, reach: float, metric: str) -> DataFrame:
    """Pairs (a, b) of representatives that are linked across nodes."""
    spread = reps.select(F.explode(_ancestors(F.col("leaf"))).alias("node"), "rep").groupBy("node").agg(F.min("rep").alias("rep"))
    held = written(nodes.join(spread, "node").join(tight.withColumn("tight", F.lit(True)), "node", "left")
                  .select("node", "lo", "hi", "is_leaf", F.coalesce("tight", F.lit(False)).alias("tight"), "rep"))
    a, b = _side(held, "a"), _side(held, "b")
    todo = written(held.where(F.col("node") == ROOT).select(F.col("node").alias("a"), F.col("node").alias("b")))
    linked, open_ = [], []
    while not todo.isEmpty():
        both = todo.join(a, "a").join(b, "b").where(_gap(metric, True) <= reach)
        whole = F.col("a_tight") & F.col("b_tight") & (_gap(metric, False) <= reach)
        judged = written(both.select("a", "b", "a_is_leaf", "b_is_leaf", "a_rep", "b_rep", whole.alias("whole")))
        linked.append(judged.where("whole AND a_rep <> b_rep").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
        rest = judged.where("NOT whole")
        open_.append(rest.where("a_is_leaf AND b_is_leaf AND a <> b").select("a", "b"))
        rest = rest.where("NOT (a_is_leaf AND b_is_leaf)")
        wide = _children(rest.where("NOT a_is_leaf").select("a", "b", "b_is_leaf"), held, "a")
        keep = rest.where("a_is_leaf").select("a", "b", "b_is_leaf").unionByName(wide.select("a", "b", "b_is_leaf"))
        deep = _children(keep.where("NOT b_is_leaf").select("a", "b"), held, "b").select("a", "b").unionByName(
            keep.where("b_is_leaf").select("a", "b"))
        # a pair of different nodes is met from both ends
        todo = written(deep.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def met(a, b):
        (x, own), (y, other) = a, b
        if own["rep"].min() == own["rep"].max() == other["rep"].min() == other["rep"].max():
            return None
        i, j = np.nonzero(_within(x, y, reach, metric))
        found = np.unique(np.stack([own["rep"][i], other["rep"][j]]), axis=1)
        found = found[:, found[0] != found[1]]
        return found[0], found[1]

    blocks = _blocks(reps, ["pid", "rep"])
    pairs = open_[0] if open_ else todo
    for more in open_[1:]:
        pairs = pairs.unionByName(more)
    out = _compared(pairs, blocks, blocks, met, "a bigint, b bigint")
    for more in linked:
        out = out.unionByName(more)
    return written(out.distinct())


def _components(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest cell reachable from each cell: alternating link and shortcut steps."""
    edges = written(links.unionAll(links.select(F.col("b"), F.col("a"))))
    roots = written(cells.select("cell", F.col("cell").alias("root")))
    if edges.isEmpty():
        return roots
    while True:
        spread = (edges.join(roots, edges["b"] == roots["cell"]).select(F.col("a").alias("cell"), "root")
                  .unionAll(roots.select("cell", "root")).groupBy("cell").agg(F.min("root").alias("root")))
        # jump to the root of the root, which halves long chains
        jump = roots.select(F.col("cell").alias("root"), F.col("root").alias("up"))
        moved = written(spread.join(jump, "root", "left").select("cell", F.least("root", F.coalesce("up", "root")).alias("root")))
        same = moved.join(roots, ["cell", "root"], "left_anti").isEmpty()
        roots = moved
        if same:
            return roots


def _border(rest: DataFrame, reps: DataFrame, nodes: DataFrame, dims: int, reach: float, metric: str) -> DataFrame:
    """(pid, rep) of spots that are no core spots, and representatives of the core spots within their reach."""
    asking = _boxes(rest, "leaf", dims)
    held = nodes.join(reps.select(F.explode(_ancestors(F.col("leaf"))).alias("node")).distinct(), "node", "left_semi")

    def met(a, b):
        (x, own), (y, other) = a, b
        i, j = np.nonzero(_within(x, y, reach, metric))
        found = np.unique(np.stack([own["pid"][i], other["rep"][j]]), axis=1)
        return found[0], found[1]

    return _compared(_near(asking, held, reach, metric), _blocks(rest, ["pid"]), _blocks(reps, ["pid", "rep"]), met, "pid bigint, rep bigint")


def dbscan(features: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean") -> DataFrame:
    """Density clusters: the rows with ``cluster``, -1 for noise.

    ``key`` must be unique. Clusters are numbered by size, then by their
    smallest key; a border point within reach of several joins the one whose
    core points have the smallest key.
    """
    x = vector_to_array("features")
    zero_apart = metric == "cosine" and eps < 1
    if metric == "cosine":
        # on the unit sphere a cosine distance of eps is a chord of sqrt(2 eps)
        norm = F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda s, v: s + v))
        x = F.transform(x, lambda v: F.when(norm > 0, v / norm).otherwise(0.0))
        eps, metric = math.sqrt(2 * eps), "euclidean"
    points = features.select(F.col(key).alias("id"), x.alias("x"))
    if zero_apart:
        # a zero vector has cosine distance 1 to everything, so it has no neighbours
        points = points.where(F.exists("x", lambda v: v != 0))
    noise = features.withColumn("cluster", F.lit(-1))
    one = points.select(F.size("x").alias("n")).first()
    if one is None:
        return noise
    dims, reach = one.n, eps if metric == "manhattan" else eps * eps
    merged = written(points.groupBy("x").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("first")))
    spots = written(_partitioned(written(merged.withColumn("pid", F.monotonically_increasing_id())), dims))
    leaves = written(_boxes(spots, "leaf", dims, F.sum("w").alias("weight")))
    nodes = written(_tree(leaves, dims))
    sure, open_ = _counted(leaves, nodes, reach, metric, min_samples)
    weighed = spots.join(leaves.select("leaf", "weight", (_width(metric) <= reach).alias("tight")), "leaf")
    told = _core_spots(weighed, _blocks(spots, ["pid", "w"]), sure, open_, reach, metric, min_samples)
    core = told.where("core")
    if core.isEmpty():
        return noise
    tight = written(nodes.where(_width(metric) <= reach).select("node"))
    reps = _represented(core, tight, reach, metric)
    roots = _components(reps.select(F.col("rep").alias("cell")).distinct(), _links(reps, nodes, tight, reach, metric))

    placed = reps.join(roots.withColumnRenamed("cell", "rep"), "rep").join(told.select("pid", "first", "w"), "pid")
    named = written(placed.groupBy("root").agg(F.min("first").alias("name")))
    groups = roots.join(named, "root").select(F.col("cell").alias("rep"), "name")
    inner = placed.join(named, "root").select("pid", "name")
    rest = told.where("NOT core")
    edge = (_border(rest, reps, nodes, dims, reach, metric).join(groups, "rep").groupBy("pid").agg(F.min("name").alias("name"))
            if not rest.isEmpty() else inner.limit(0))
    assigned = written(inner.unionByName(edge).join(told.select("pid", "x", "first", "w"), "pid"))
    sizes = assigned.groupBy("name").agg(F.sum("w").alias("n"))
    numbered = running_total(sizes, [F.desc("n"), F.asc("name")], F.lit(1), "cluster").select("name", F.col("cluster").cast("int"))
    labelled = points.join(assigned.join(numbered, "name").select("x", "cluster"), "x").select(F.col("id").alias(key), "cluster")
    return features.join(labelled, key, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
