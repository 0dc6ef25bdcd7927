"""Exact pairs of vectors above a cosine, by dual traversal of cover trees.

Unit vectors of cosine >= t lie within the distance sqrt(2 - 2 t). Equal vectors
are one class. Classes go to cells, the nodes of a first cover level around a
bounded set of pivots; cells too far apart for their covering radii never meet.
Large cells are cut into blocks. Every block gets a cover tree of nested levels
with halving radii: a node's children are its own centre and points more than
the next radius from each other. A pair of blocks is compared from the roots
down; a pair of nodes goes on only if the distance of their centres is at most
the threshold plus both covering radii, the true ones of the nodes' points. A
level with nearly as many nodes as points is not visited. What is left of
points is compared in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from llm.common import by_group, components, linked, saved

THRESHOLD = 0.9
BLOCK = 2048
# rows from which pivots are chosen, and most pivots of a length: fixed bounds of what is collected and sent
PIVOT_ROWS = 4096
PIVOTS = 64
RADII = [2.0, 1.0, 0.5, 0.25, 0.125]
SLACK = 1e-9
# a level is visited if it has so many times fewer pairs of nodes than there are pairs of points
WORTH = 4
# up to this share of pairs left, they are compared one by one, otherwise as a matrix product
SPARSE = 0.002


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that no square overflows."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(id, cls, dim, raw): cls and raw are null for vectors that link with nothing."""
    kind = "<f4" if isinstance(vectors.schema["vector"].dataType, ArrayType) and isinstance(
        vectors.schema["vector"].dataType.elementType, FloatType) else "<f8"
    key = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, cls, dim = [], [], []
            for v in batch.column("vector"):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), kind) + 0
                good = x is not None and len(x) and np.isfinite(x).all() and (x != 0).any()
                raw.append(x.tobytes() if good else None)
                cls.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if good else None)
                dim.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cls, pa.binary()), pa.array(dim, pa.int32()),
                                              pa.array(raw, pa.binary())], ["id", "cls", "dim", "raw"])

    return vectors.mapInArrow(run, f"id {key}, cls binary, dim int, raw binary"), kind


def pivots_of(classes: DataFrame, kind: str, wanted: int) -> dict[int, np.ndarray]:
    """Pivots of every vector length: far from each other, among at most PIVOT_ROWS rows."""
    rows = classes.orderBy("cls").limit(PIVOT_ROWS).select("dim", "raw").collect()
    out = {}
    for dim in {r.dim for r in rows}:
        x = units([bytes(r.raw) for r in rows if r.dim == dim], kind)
        picked, near = [0], np.linalg.norm(x - x[0], axis=1)
        while len(picked) < min(wanted, len(x)) and near.max() > RADII[2]:
            picked.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(x - x[picked[-1]], axis=1))
        out[dim] = x[picked]
    return out


def tree(x: np.ndarray) -> np.ndarray:
    """For every point the row of its node's centre at each level; the root's centre is row 0."""
    path = np.zeros((len(x), len(RADII)), np.int32)
    for level, radius in enumerate(RADII[1:], 1):
        order = np.argsort(path[:, level - 1], kind="stable")
        parents = path[order, level - 1]
        cuts = [0, *(np.flatnonzero(np.diff(parents)) + 1).tolist(), len(x)]
        for a, b in zip(cuts, cuts[1:]):
            centre, left = parents[a], order[a:b]
            while len(left):
                dots = x[left] @ x[centre]
                far = 2 - 2 * dots > radius * radius
                far[left == centre] = False
                path[left[~far], level] = centre
                left = left[far]
                centre = left[0] if len(left) else 0
    return path


def _covers(x: np.ndarray, path: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of a level, their covering radii, and every point's node."""
    centres, node = np.unique(path[:, level], return_inverse=True)
    away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[centres][node])))
    radius = np.zeros(len(centres))
    np.maximum.at(radius, node, away)
    return centres, radius, node


def dual(x: np.ndarray, x_path: np.ndarray, y: np.ndarray, y_path: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs with a cosine of at least ``threshold``."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    alive, a_of, b_of = np.ones((1, 1), bool), np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    for level in range(len(RADII)):
        a, ra, a_node = _covers(x, x_path, level)
        b, rb, b_node = _covers(y, y_path, level)
        if level and WORTH * len(a) * len(b) > len(x) * len(y):
            # nearly as many nodes as points: comparing nodes costs what comparing the points does
            break
        alive = alive[a_of[a][:, None], b_of[b]]
        if alive.mean() > SPARSE:
            away = np.sqrt(np.maximum(0, 2 - 2 * (x[a] @ y[b].T)))
            alive &= away <= reach + ra[:, None] + rb
        else:
            i, j = np.nonzero(alive)
            away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[a[i]], y[b[j]])))
            alive[i, j] = away <= reach + ra[i] + rb[j]
        a_of, b_of = a_node, b_node
        if not alive.any():
            return np.zeros((len(x), len(y)), bool)
    close = alive[a_of[:, None], b_of]
    if close.mean() > SPARSE:
        return close & (x @ y.T >= threshold)
    i, j = np.nonzero(close)
    close[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return close


def _compared(threshold: float, kind: str):
    def act(cell: pa.Table) -> pa.Table | None:
        block = cell.column("block").to_numpy()
        sides = [np.flatnonzero(block == b) for b in np.unique(block)]
        raw, cls = cell.column("raw").to_pylist(), cell.column("cls").to_pylist()
        copies, path = cell.column("copies").to_numpy(), np.frombuffer(b"".join(cell.column("path").to_pylist()), np.int32)
        path, place = path.reshape(len(raw), -1), cell.column("place").to_numpy()
        parts = []
        for side in sides:
            side = side[np.argsort(place[side])]
            parts.append((side, units([raw[i] for i in side], kind), path[side]))
        if cell.column("i")[0].as_py() == cell.column("j")[0].as_py():
            parts.append(parts[0])
        elif len(parts) < 2:
            return None
        (a, x, xp), (b, y, yp) = parts
        close = dual(x, xp, y, yp, threshold)
        if parts[0] is parts[1]:
            np.fill_diagonal(close, False)
            links = {int(i): int(n) for i, n in zip(a, close @ copies[a]) if n}
            edges = [(int(a[i]), int(a[j])) for i, j in linked(close)]
        else:
            links = {int(i): int(n) for i, n in [*zip(a, close @ copies[b]), *zip(b, copies[a] @ close)] if n}
            edges = [(int(a[i]), int(b[j])) for i, j in _across(close)]
        if not links:
            return None
        return pa.table({"a": pa.array([cls[i] for i in links] + [cls[i] for i, _ in edges], pa.binary()),
                         "b": pa.array([None] * len(links) + [cls[j] for _, j in edges], pa.binary()),
                         "links": pa.array([*links.values(), *[0] * len(edges)], pa.int64())})

    return act


def _across(close: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite matrix."""
    n, m = close.shape
    rows, columns = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
    small = close[np.ix_(rows, columns)]
    square = np.zeros((sum(small.shape),) * 2, bool)
    square[:len(rows), len(rows):] = small
    square[len(rows):, :len(rows)] = small.T
    kept = [(min(a, b), max(a, b)) for a, b in linked(square)]
    return [(int(rows[a]), int(columns[b - len(rows)])) for a, b in kept]


def join(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector: key, n_links, component_id, kept.

    A link joins vectors of equal length with a cosine of at least ``threshold``
    (positive) in double precision. Null, empty or zero vectors and those with
    null or non-finite components link with nothing and are components of their
    own. Repeated rows and equal vectors are vectors of their own and links of
    each other; component_id is the smallest key reached, null keys only if
    there is no other. Other columns are left out; an empty table gives an
    empty result.
    """
    told, kind = classes_of(vectors.select(vectors[key].alias("id"), vectors[vector].alias("vector")))
    told = saved(told, "vectors")
    classes = saved(told.where("cls is not null").groupBy("cls").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw")), "vector-classes")
    n = classes.count()
    pivots = pivots_of(classes, kind, max(1, min(PIVOTS, n // BLOCK)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            dims, raw = batch.column("dim").to_numpy(), batch.column("raw").to_pylist()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                if int(dim) in pivots:
                    dots = units([raw[i] for i in own], kind) @ pivots[int(dim)].T
                    cell[own] = dots.argmax(1)
                    away[own] = np.sqrt(np.maximum(0, 2 - 2 * dots.max(1)))
                else:
                    away[own] = 2.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    celled = classes.mapInArrow(near, "cls binary, least {0}, copies bigint, dim int, raw binary, cell int, away double".format(
        classes.schema["least"].dataType.simpleString()))
    cells = celled.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    cells = cells.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = (celled.join(F.broadcast(cells.select("dim", "cell", "blocks")), ["dim", "cell"])
              .withColumn("nth", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
              .withColumn("block", F.xxhash64("dim", "cell", "nth")))

    def grown(block: pa.Table) -> pa.Table:
        path = tree(units(block.column("raw").to_pylist(), kind))
        return pa.table([block.column(c) for c in ("cls", "copies", "raw", "dim", "cell", "block")]
                        + [pa.array(range(len(path)), pa.int32()), pa.array([p.tobytes() for p in path], pa.binary())],
                        ["cls", "copies", "raw", "dim", "cell", "block", "place", "path"])

    trees = saved(by_group(placed.select("cls", "copies", "raw", "dim", "cell", "block"), ["block"], ["cls"], grown,
                           "cls binary, copies bigint, raw binary, dim int, cell int, block bigint, place int, path binary"), "vector-trees")
    meet = _meeting(cells, pivots, threshold, classes.sparkSession)
    other = placed.select("dim", F.col("cell").alias("cell_2"), F.col("block").alias("block_2")).distinct()
    blocks = placed.select("dim", "cell", "block").distinct().join(meet, ["dim", "cell"]).join(other, ["dim", "cell_2"])
    pairs = blocks.select("block", F.least("block", "block_2").alias("i"), F.greatest("block", "block_2").alias("j"))
    shape = "a binary, b binary, links bigint"
    checked = saved(by_group(trees.join(pairs, "block"), ["i", "j"], [], _compared(threshold, kind), shape), "vector-links")
    links = checked.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(checked.where("b is not null").select("a", "b"))
    part = (classes.select("cls", "least", "copies").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
            .withColumn("root", F.coalesce("root", "cls")))
    known = (part.join(part.groupBy("root").agg(F.min("least").alias("component")), "root").join(links, "cls", "left")
             .select("cls", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    lone = F.col("cls").isNull()
    found = told.select("id", "cls").join(known, "cls", "left")
    component = F.when(lone, F.col("id")).otherwise(F.col("component"))
    return found.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _meeting(cells: DataFrame, pivots: dict[int, np.ndarray], threshold: float, spark) -> DataFrame:
    """(dim, cell, cell_2) of cells whose covering radii let them hold a pair; at most PIVOTS squared of a length."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    found = []
    rows = cells.select("dim", "cell", "radius").collect()
    for dim in {r.dim for r in rows}:
        own = [r for r in rows if r.dim == dim]
        for r in own:
            for s in own:
                away = np.linalg.norm(pivots[dim][r.cell] - pivots[dim][s.cell]) if dim in pivots else 0.0
                if away <= reach + r.radius + s.radius:
                    found.append((dim, r.cell, s.cell))
    return F.broadcast(spark.createDataFrame(found, "dim int, cell int, cell_2 int"))
