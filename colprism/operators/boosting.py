"""Gradient boosting on binned features, trees grown leaf by leaf.

Features are cut into at most ``BINS`` bins once. Rows are packed into blocks
of binned columns, and what leaves a task is a histogram per tree node: sums of
gradients, hessians and rows per feature and bin, added up over the blocks.
A node's split is the best cut of its histogram,

    gain = GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2),

and the leaf with the largest gain is split next, until a tree has ``leaves``
leaves. One pass over the blocks serves all leaves that would be split next by
what is known so far, so a tree takes about as many passes as it has levels,
and yet is the tree that splitting one leaf at a time gives. Only the smaller
child of a node is counted; the other is the difference.

Losses: squared error; log loss of two classes; softmax of more, one tree per
class and round. With early stopping, rounds end when the loss of the rows held
back has not fallen for ``PATIENCE`` rounds, and trees after the best round go.

A table whose bins fit one block of ``BLOCK_BYTES`` is one block: the sum over
blocks is then that block's own, and all passes run in its task. Larger tables
take a Spark job per pass: sums are added up by feature and stay where they are
added, and what reaches the driver is a split per node and feature. The growing
code is the same. Every ``REFRESH`` rounds blocks are written anew with their scores, so
a lost block is read again and needs the trees since then only.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Transformer
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprism.session import remove, scratch_path

BINS = 255
PATIENCE, LEAST_FALL = 10, 1e-7
LEAST_HESSIAN = 1e-3
BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 64 << 20
REFRESH = 16
WIDE = 64          # features whose cuts are found in one pass
KEYS = 4           # features whose histograms a task adds up, at least
SQUARED, LOGISTIC, SOFTMAX = "squared_error", "log_loss", "softmax"


@dataclass
class Settings:
    loss: str
    classes: int = 1          # trees per round: 1, or the classes of softmax
    learning_rate: float = 0.1
    rounds: int = 200
    leaves: int = 31
    depth: int | None = None
    least: int = 20           # rows of a leaf
    l2: float = 0.0
    early_stopping: bool = False


@dataclass
class Node:
    """A node of a growing tree; ``feature`` and ``cut`` are its best split, whether or not it is made."""

    depth: int
    total: np.ndarray                # gradients, hessians, rows
    feature: int = -1
    cut: int = -1
    gain: float = 0.0
    left: int = -1
    right: int = -1
    smaller_left: bool = True


@dataclass
class Tree:
    """feature (-1 in leaves), cut (a bin), children, value and gain of every node; the root is the first."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]


@dataclass
class Found:
    """What the histograms of some features say of a node: its sums, its best split, and whether the left side of it is the smaller."""

    total: np.ndarray
    gain: float = 0.0
    feature: int = -1
    cut: int = -1
    smaller_left: bool = True


def best_split(counts: np.ndarray, total: np.ndarray, settings: Settings, first: int = 0) -> Found:
    """The best cut of a node by histograms of features from ``first`` on; ties go to the first feature and its lowest cut."""
    s = settings
    left = counts.cumsum(axis=2)[:, :, :-1]
    if not left.size:
        return Found(total)
    g, h, n = left
    all_g, all_h, all_n = total
    fits = (n >= s.least) & (all_n - n >= s.least) & (h >= LEAST_HESSIAN) & (all_h - h >= LEAST_HESSIAN)
    parts = np.where(fits, g * g / np.where(fits, h + s.l2, 1.0) + (all_g - g) ** 2 / np.where(fits, all_h - h + s.l2, 1.0), 0.0)
    gain = parts - all_g ** 2 / max(all_h + s.l2, 1e-300)
    # what is left of equal terms by rounding is no gain
    gain = np.where(fits & (gain > 1e-12 * parts), gain, 0.0)
    f, cut = divmod(int(gain.argmax()), gain.shape[1])
    return Found(total, float(gain[f, cut]), first + f, cut, bool(n[f, cut] * 2 <= all_n))


class Leaves:
    """Histograms of some features, and the sums, of a growing tree's leaves by node."""

    def __init__(self) -> None:
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def take(self, counted: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], children: dict[int, tuple[int, int]]) -> list[int]:
        """Gives counted nodes their children, the larger as the difference; the nodes that are new."""
        new = []
        for (node, side), (counts, total) in counted.items():
            if side == "self":
                self.held = {0: (counts, total)}
                return [0]
            all_counts, all_total = self.held.pop(node)
            smaller, larger = (counts, total), (all_counts - counts, all_total - total)
            for child, one in zip(children[node], (smaller, larger) if side == "left" else (larger, smaller)):
                self.held[child] = one
                new.append(child)
        return new


class Growing:
    """A tree in growth from the best splits of its nodes. Node ids are handed out once; what is split in the end is decided last."""

    def __init__(self, settings: Settings, root: Found):
        self.settings, self.nodes = settings, []
        self._add(root, 0)

    def _add(self, found: Found, depth: int) -> int:
        node = Node(depth, found.total)
        if self.settings.depth is None or depth < self.settings.depth:
            node.feature, node.cut, node.gain, node.smaller_left = found.feature, found.cut, found.gain, found.smaller_left
        self.nodes.append(node)
        return len(self.nodes) - 1

    def simulate(self) -> tuple[list[int], list[int]]:
        """Splits in order of gain as far as nodes are known: what is split, and what of it still lacks its children."""
        split, open_ = [], []
        waiting = [(-self.nodes[0].gain, 0)]
        while waiting and len(split) < self.settings.leaves - 1:
            gain, i = heapq.heappop(waiting)
            if gain >= 0:
                break
            split.append(i)
            node = self.nodes[i]
            if node.left < 0:
                open_.append(i)
                continue
            for child in (node.left, node.right):
                heapq.heappush(waiting, (-self.nodes[child].gain, child))
        return split, open_

    def expand(self, i: int, left: Found, right: Found) -> None:
        """Gives node ``i`` its children."""
        node = self.nodes[i]
        node.left, node.right = self._add(left, node.depth + 1), self._add(right, node.depth + 1)

    def finished(self) -> Tree:
        made = set(self.simulate()[0])
        order = [0]
        for i in order:
            if i in made:
                order += [self.nodes[i].left, self.nodes[i].right]
        place = {i: k for k, i in enumerate(order)}
        tree = Tree([], [], [], [], [], [])
        for i in order:
            node, inner = self.nodes[i], i in made
            g, h, _ = node.total
            tree.feature.append(node.feature if inner else -1)
            tree.cut.append(node.cut if inner else -1)
            tree.left.append(place[node.left] if inner else -1)
            tree.right.append(place[node.right] if inner else -1)
            tree.value.append(float(-self.settings.learning_rate * g / (h + self.settings.l2 + 1e-300)))
            tree.gain.append(node.gain if inner else 0.0)
        return tree


@dataclass
class Pass:
    """What one pass over the blocks is asked for.

    trees: those of all rounds since the blocks were written. splits: by class,
    (node, feature, cut, left, right) of the tree in growth, parents first;
    child ids are -1 where they are not known yet. wanted: (class, node, whether
    its left or right child, or the node itself, is counted). children: by
    class, the ids that the children of wanted nodes get.
    """

    trees: list[list[Tree]]
    splits: dict[int, list[tuple]]
    wanted: list[tuple[int, int, str]]
    losses: bool = False
    children: dict[int, dict[int, tuple[int, int]]] = field(default_factory=dict)


class Block:
    """Binned columns of some rows, with labels, weights and the scores of the trees so far."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, held: np.ndarray, raw: np.ndarray, settings: Settings):
        self.bins, self.label, self.weight, self.held, self.raw, self.settings = bins, label, weight, held, raw, settings
        self.applied = 0
        self.begin()

    def begin(self) -> None:
        self.members: dict[tuple[int, int], np.ndarray] = {}
        self.slopes: list[tuple[np.ndarray, np.ndarray]] | None = None

    def catch_up(self, trees: list[list[Tree]]) -> None:
        """Adds the scores of trees that came since."""
        for round_ in trees[self.applied:]:
            for k, tree in enumerate(round_):
                todo = [(0, np.arange(len(self.label)))]
                while todo:
                    i, rows = todo.pop()
                    if tree.feature[i] < 0:
                        self.raw[k, rows] += tree.value[i]
                        continue
                    goes = self.bins[tree.feature[i]][rows] <= tree.cut[i]
                    todo += [(tree.left[i], rows[goes]), (tree.right[i], rows[~goes])]
            self.applied += 1
            self.begin()

    def probabilities(self) -> np.ndarray:
        if self.settings.loss == LOGISTIC:
            return 1.0 / (1.0 + np.exp(-self.raw))
        spread = np.exp(self.raw - self.raw.max(axis=0))
        return spread / spread.sum(axis=0)

    def gradients(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By class, gradients and hessians; zero for rows held back."""
        if self.slopes is None:
            used = np.where(self.held, 0.0, self.weight)
            if self.settings.loss == SQUARED:
                self.slopes = [(used * (self.raw[0] - self.label), used)]
            else:
                p = self.probabilities()
                truth = [self.label == (1 if self.settings.loss == LOGISTIC else k) for k in range(len(p))]
                self.slopes = [(used * (p[k] - truth[k]), used * p[k] * (1 - p[k])) for k in range(len(p))]
        return self.slopes

    def losses(self) -> np.ndarray:
        """Loss and weight of the rows that are fitted, then of those held back."""
        if self.settings.loss == SQUARED:
            each = 0.5 * (self.raw[0] - self.label) ** 2
        elif self.settings.loss == LOGISTIC:
            each = np.logaddexp(0.0, self.raw[0]) - self.label * self.raw[0]
        else:
            top = self.raw.max(axis=0)
            each = top + np.log(np.exp(self.raw - top).sum(axis=0)) - self.raw[self.label.astype(int), np.arange(len(self.label))]
        parts = [(each[m] @ self.weight[m], self.weight[m].sum()) for m in (~self.held, self.held)]
        return np.array([x for p in parts for x in p])

    def rows_of(self, k: int, node: int, side: str, splits: list[tuple]) -> np.ndarray:
        """Rows in a node of the tree in growth, or of the side its split would send left or right."""
        if (k, 0) not in self.members:
            self.members[k, 0] = np.arange(len(self.label))
        for i, feature, cut, left, right in splits:
            if left >= 0 and (k, left) not in self.members:
                rows = self.members[k, i]
                goes = self.bins[feature][rows] <= cut
                self.members[k, left], self.members[k, right] = rows[goes], rows[~goes]
        rows = self.members[k, node]
        if side == "self":
            return rows
        _, feature, cut, _, _ = next(s for s in splits if s[0] == node)
        return rows[(self.bins[feature][rows] <= cut) == (side == "left")]

    def histogram(self, rows: np.ndarray, k: int) -> np.ndarray:
        """(3, features, bins): sums of gradients, hessians and rows."""
        g, h = self.gradients()[k]
        g, h, n = g[rows], h[rows], (~self.held[rows]).astype(float)
        out = np.zeros((3, len(self.bins), BINS + 1))
        for f, column in enumerate(self.bins):
            at = column[rows].astype(np.intp)
            for i, weights in enumerate((g, h, n)):
                out[i, f] = np.bincount(at, weights, BINS + 1)
        return out


def worked(blocks: Iterator[Block], asked: Pass) -> dict:
    """The sums of a pass over some blocks: losses, and by class the histograms and sums of the wanted nodes."""
    out: dict = {}
    for block in blocks:
        block.catch_up(asked.trees)
        found: dict = {}
        for k, node, side in asked.wanted:
            counts = block.histogram(block.rows_of(k, node, side, asked.splits.get(k, [])), k)
            found.setdefault(k, {})[node, side] = (counts, counts[:, 0].sum(axis=1))
        if asked.losses:
            found["losses"] = block.losses()
        out = {key: merged(out[key], value) if key in out else value for key, value in found.items()}
    return out


def merged(a, b):
    if not isinstance(a, dict):
        return a + b
    return {key: (a[key][0] + counts, a[key][1] + total) for key, (counts, total) in b.items()}


def by_feature(sums: dict, sizes: list[int]) -> Iterator[tuple[int, object]]:
    """Sums under one number per class and feature, each histogram as long as its feature has bins; losses under -1."""
    for key, found in sums.items():
        if key == "losses":
            yield -1, found
            continue
        for f, size in enumerate(sizes):
            yield key * len(sizes) + f, {at: (counts[:, f:f + 1, :size], total) for at, (counts, total) in found.items()}


def grown(total: Callable[[Pass], tuple[dict[tuple[int, int], Found], np.ndarray | None]], settings: Settings, refresh: Callable[[list[list[Tree]]], None] | None = None) -> tuple[list[list[Tree]], list]:
    """All rounds: the trees by round and class, and the losses before the first round and after each."""
    trees: list[list[Tree]] = []
    losses: list[tuple[float, float | None]] = []
    since = 0

    def note(found: np.ndarray) -> None:
        fitted, weight, held, held_weight = found
        losses.append((float(fitted / max(weight, 1e-300)), float(held / held_weight) if held_weight else None))

    while len(trees) < settings.rounds:
        found, losses_ = total(Pass(trees[since:], {}, [(k, 0, "self") for k in range(settings.classes)], True))
        note(losses_)
        if settings.early_stopping and _stalled(losses):
            break
        growing = [Growing(settings, found[k, 0]) for k in range(settings.classes)]
        while True:
            opened = {k: g.simulate()[1] for k, g in enumerate(growing)}
            wanted = [(k, i, "left" if growing[k].nodes[i].smaller_left else "right") for k, ids in opened.items() for i in ids]
            if not wanted:
                break
            splits = {k: [(i, n.feature, n.cut, n.left, n.right) for i, n in enumerate(growing[k].nodes) if n.left >= 0 or i in ids]
                      for k, ids in opened.items()}
            children = {k: {i: (len(growing[k].nodes) + 2 * at, len(growing[k].nodes) + 2 * at + 1) for at, i in enumerate(ids)}
                        for k, ids in opened.items()}
            found, _ = total(Pass(trees[since:], splits, wanted, children=children))
            for k, i, _ in wanted:
                growing[k].expand(i, *(found[k, child] for child in children[k][i]))
        made = [g.finished() for g in growing]
        if all(t.feature[0] < 0 for t in made):
            break
        trees.append(made)
        if refresh and len(trees) - since == REFRESH:
            refresh(trees[since:])
            since = len(trees)
    if len(losses) <= len(trees):
        note(total(Pass(trees[since:], {}, [], True))[1])
    if settings.early_stopping:
        trees = trees[:min(range(len(losses)), key=lambda i: _followed(losses[i]))]
    return trees, losses


def _followed(loss: tuple[float, float | None]) -> float:
    return loss[0] if loss[1] is None else loss[1]


def _stalled(losses: list[tuple[float, float | None]]) -> bool:
    if len(losses) <= PATIENCE:
        return False
    before, last = losses[:-PATIENCE], losses[-PATIENCE:]
    return min(map(_followed, last)) > min(map(_followed, before)) - LEAST_FALL


def bin_cuts(rows: DataFrame, size: int) -> list[np.ndarray]:
    """For every feature, ascending cuts between its bins: its smallest value and its quantiles, without its largest value."""
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    cuts = []
    for start in range(0, size, WIDE):
        wide = [(f"x{i}", F.get("x", F.lit(i))) for i in range(start, min(size, start + WIDE))]
        found = rows.agg(*[x for n, c in wide for x in (F.min(c).alias(f"{n}_low"), F.max(c).alias(f"{n}_high"),
                                                         F.percentile_approx(c, shares, 10_000).alias(f"{n}_mid"))]).first()
        for n, _ in wide:
            values = np.unique(np.array([found[f"{n}_low"], *(found[f"{n}_mid"] or [])], float))
            cuts.append(values[values < found[f"{n}_high"]])
    return cuts


def packed(cuts: list[np.ndarray], base: np.ndarray, block_rows: int):
    """Bins rows and packs them, ``block_rows`` at a time."""
    def pack(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        n = rows.num_rows
        x = rows.column("x").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]).astype(np.uint8)
        values = [rows.column(c).to_numpy().astype(float) for c in ("label", "weight")]
        held = rows.column("held").to_numpy().astype(bool)
        blobs = [bins, *values, held, np.repeat(base[:, None], n, 1)]
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)],
                                          ["n", "bins", "label", "weight", "held", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= block_rows:
                yield pack(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield pack(pa.Table.from_batches(held))
    return run


BLOCK = "n bigint, bins binary, label binary, weight binary, held binary, raw binary"


def _block(row, settings: Settings) -> Block:
    read = lambda blob, kind: np.frombuffer(bytes(blob), kind)
    return Block(read(row.bins, np.uint8).reshape(-1, row.n), read(row.label, float), read(row.weight, float), read(row.held, bool),
                 read(row.raw, float).reshape(-1, row.n).copy(), settings)


def _advanced(settings: Settings, trees: list[list[Tree]]):
    """Blocks with the scores of ``trees`` added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).to_pylist()
            for row in rows:
                block = _block(_Row(**row), settings)
                block.catch_up(trees)
                row["raw"] = block.raw.tobytes()
            yield pa.RecordBatch.from_pylist(rows, batch.schema)
    return run


@dataclass
class _Row:
    n: int
    bins: bytes
    label: bytes
    weight: bytes
    held: bytes
    raw: bytes


class _Store:
    """The blocks as a table in the shared folder, replaced from time to time."""

    def __init__(self, spark: SparkSession, blocks: DataFrame, settings: Settings, sizes: list[int]):
        self.spark, self.settings, self.sizes, self.path, self.leaves = spark, settings, sizes, None, None
        self.write(blocks)

    def write(self, blocks: DataFrame) -> None:
        path = scratch_path(self.spark, "boosting")
        blocks.write.parquet(path)
        old, self.path = self.path, path
        self.table = self.spark.read.schema(BLOCK).parquet(path)
        settings = self.settings
        # every task sends its sums, so there are no more tasks than cores
        self.blocks = self.table.rdd.coalesce(self.spark.sparkContext.defaultParallelism).map(lambda row: _block(row, settings))
        if old:
            remove(self.spark, old)

    def refresh(self, trees: list[list[Tree]]) -> None:
        self.write(self.table.mapInArrow(_advanced(self.settings, trees), BLOCK))

    def total(self, asked: Pass) -> tuple[dict[tuple[int, int], Found], np.ndarray | None]:
        """The best splits of new nodes, and losses if asked for.

        Histograms are added up by class and feature and stay in the tasks that
        hold a feature, with those of the leaves found before; the driver gets
        a split per node and feature.
        """
        settings, sizes, features = self.settings, self.sizes, len(self.sizes)
        parts = min(self.spark.sparkContext.defaultParallelism, max(1, features * settings.classes // KEYS))
        sums = self.blocks.mapPartitions(lambda blocks: by_feature(worked(blocks, asked), sizes)).reduceByKey(merged, parts)
        if not asked.wanted:
            return {}, dict(sums.collect()).get(-1)
        if all(side == "self" for _, _, side in asked.wanted):
            before = sums.mapValues(lambda found: (Leaves(), found))
        else:
            # the same keys in the same parts, so this join moves nothing
            before = self.leaves.mapValues(lambda kept: kept[0]).leftOuterJoin(sums, parts)

        def step(key: int, leaves: Leaves, counted) -> tuple:
            if key < 0:
                return leaves, counted
            after = Leaves()
            after.held = dict(leaves.held)
            k, f = divmod(key, features)
            new = after.take(counted or {}, asked.children.get(k, {}))
            return after, {(k, node): best_split(*after.held[node], settings, f) for node in new}

        after = before.map(lambda row: (row[0], step(row[0], *row[1])), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        found: dict[tuple[int, int], Found] = {}
        losses = None
        for key, told in sorted(after.mapValues(lambda kept: kept[1]).collect(), key=lambda row: row[0]):
            if key < 0:
                losses = told
                continue
            for at, one in told.items():
                # ties go to the first feature
                if at not in found or one.gain > found[at].gain:
                    found[at] = one
        self.forget()
        self.leaves = after
        return found, losses

    def forget(self) -> None:
        if self.leaves is not None:
            self.leaves.unpersist()

    def grown_in_one_task(self) -> tuple[list[list[Tree]], list]:
        settings = self.settings

        def run(blocks: Iterator[Block]) -> Iterator[tuple]:
            kept = list(blocks)
            leaves = [Leaves() for _ in range(settings.classes)]

            def total(asked: Pass) -> tuple:
                sums = worked(kept, asked)
                losses = sums.pop("losses", None)
                return {(k, node): best_split(*leaves[k].held[node], settings) for k, counted in sums.items()
                        for node in leaves[k].take(counted, asked.children.get(k, {}))}, losses
            if kept:
                yield grown(total, settings)
        return self.blocks.coalesce(1).mapPartitions(run).first()


@dataclass
class Boosted:
    """A fitted model: MLlib stages that score ``features``, share of gain per feature, and losses by round (fitted, held back)."""

    stages: list[Transformer]
    featureImportances: DenseVector
    trees: list[list[Tree]]
    losses: list[tuple[float, float | None]]
    cuts: list[np.ndarray] = field(default_factory=list)


def fit_boosting(ready: DataFrame, settings: Settings, held: str | None = None) -> Boosted:
    """Fits to ``features``, ``label`` (class numbers for classes) and ``weight`` (1 if absent); ``held`` marks rows held back."""
    spark = ready.sparkSession
    rows = ready.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"),
                        (F.col("weight") if "weight" in ready.columns else F.lit(1.0)).cast("double").alias("weight"),
                        (F.col(held) if held else F.lit(False)).alias("held"))
    one = rows.select(F.size("x").alias("n")).first()
    if one is None:
        raise ValueError("there are no rows to fit")
    cuts = bin_cuts(rows, one.n)
    base = _base(rows, settings)
    n = rows.count()
    single = n * max(1, len(cuts)) <= BLOCK_BYTES
    blocks = (rows.coalesce(1) if single else rows).mapInArrow(packed(cuts, base, n if single else BLOCK_ROWS), BLOCK)
    store = _Store(spark, blocks, settings, [len(c) + 1 for c in cuts])
    try:
        trees, losses = store.grown_in_one_task() if single else grown(store.total, settings, store.refresh)
    finally:
        store.forget()
        remove(spark, store.path)
    gains = np.zeros(len(cuts))
    for round_ in trees:
        for tree in round_:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    gains[f] += gain
    return Boosted(_stages(spark, trees, cuts, base, settings), DenseVector(gains / (gains.sum() or 1.0)), trees, losses, cuts)


def _base(rows: DataFrame, settings: Settings) -> np.ndarray:
    """The score before any tree, by class."""
    fitted = rows.where("NOT held")
    if settings.loss == SQUARED:
        total = fitted.agg(F.sum(F.col("label") * F.col("weight")), F.sum("weight")).first()
        return np.array([total[0] / total[1] if total[1] else 0.0])
    weights = {int(r.label): r.w for r in fitted.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    whole = sum(weights.values()) or 1.0
    if settings.loss == LOGISTIC:
        p = min(max(weights.get(1, 0.0) / whole, 1e-12), 1 - 1e-12)
        return np.array([np.log(p / (1 - p))])
    return np.log([max(weights.get(k, 0.0) / whole, 1e-12) for k in range(settings.classes)])


def _stages(spark: SparkSession, trees: list[list[Tree]], cuts: list[np.ndarray], base: np.ndarray, settings: Settings) -> list[Transformer]:
    """The trees as MLlib models, so that scoring and saving need Spark alone."""
    names = ["prediction"] if settings.loss != SOFTMAX else [f"__raw_{k}" for k in range(settings.classes)]
    models = []
    for k, name in enumerate(names):
        # MLlib's boosted classes take half the log odds
        scale = 0.5 if settings.loss == LOGISTIC else 1.0
        columns = [Tree([-1], [-1], [-1], [-1], [float(base[k])], [0.0]), *(r[k] for r in trees)]
        made = _ensemble(spark, columns, cuts, scale, classes=settings.loss == LOGISTIC)
        made.setFeaturesCol("features").setPredictionCol(name)
        models.append(made)
    if settings.loss != SOFTMAX:
        return models
    raw = ", ".join(names)
    best = f"cast(array_position(array({raw}), array_max(array({raw}))) - 1 AS double)"
    return [*models, SQLTransformer(statement=f"SELECT * EXCEPT ({raw}), {best} AS prediction FROM __THIS__")]


def java_tree(spark: SparkSession, tree: Tree, cuts: list[np.ndarray], scale: float = 1.0):
    """MLlib's own form of a tree; it scores and saves, and has no statistics of the rows."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml = jvm.org.apache.spark.ml
    nothing = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(gateway.new_array(gateway.jvm.double, 3), 0)

    def node(i: int):
        value = float(tree.value[i]) * scale
        if tree.feature[i] < 0:
            return ml.tree.LeafNode(value, 0.0, nothing)
        f = tree.feature[i]
        split = ml.tree.ContinuousSplit(f, float(cuts[f][tree.cut[i]]))
        return ml.tree.InternalNode(value, 0.0, float(tree.gain[i]), node(tree.left[i]), node(tree.right[i]), split, nothing)

    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("tree")
    return ml.regression.DecisionTreeRegressionModel(uid, node(0), len(cuts))


def _ensemble(spark: SparkSession, trees: list[Tree], cuts: list[np.ndarray], scale: float, classes: bool):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml = jvm.org.apache.spark.ml
    array, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees)), gateway.new_array(gateway.jvm.double, len(trees))
    for i, tree in enumerate(trees):
        array[i], weights[i] = java_tree(spark, tree, cuts, scale), 1.0
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("boosted")
    if classes:
        return GBTClassificationModel(ml.classification.GBTClassificationModel(uid, array, weights, len(cuts), 2))
    return GBTRegressionModel(ml.regression.GBTRegressionModel(uid, array, weights, len(cuts)))
