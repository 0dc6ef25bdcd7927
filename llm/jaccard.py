"""Set-similarity self-join of texts on five-word shingles by chosen paths.

Texts with equal shingle sets are one class. Every class has ``COORDINATES``
min-hashes of its set: coordinate i is a shingle sampled so that two sets share
it with a chance of their Jaccard similarity. A run starts with all classes in
one node; a node picks ``FAN`` coordinates by its own hash and splits its
classes by the shingles they have there. A node of one class ends, a node of at
most ``SMALL`` classes is compared by brute force, a larger one is split again.
A large node that got more than the share ``TIGHT`` of the node above it holds
sets that are alike throughout, which no split parts: it is compared by brute
force in blocks, as are nodes still large after ``DEPTH`` splits. Runs differ by
their hash only.

A pair of similarity s stays together in a run with a chance of at least the
fixed point of q = 1 - (1 - s q)^FAN; the number of runs follows from the recall
asked for. Comparisons are exact: candidates by min-hash agreement decide only
which classes' sets are read again from the texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import by_group, components, fresh, if_small, linked, saved
from llm.words import distinct, mixed, shingles, slices, words

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9999
COORDINATES = 64
FAN = 2
DEPTH = 4
SMALL = 256
TIGHT = 0.5
BLOCK = 1024
# min-hash agreement this many standard deviations under the threshold still makes a candidate
SIGMAS = 4.0
SLICE = 1 << 20     # bytes of text whose shingles are made together, which bounds the arrays of a task


def runs_for(threshold: float, recall: float, fan: int = FAN) -> int:
    """Runs after which a pair at the threshold was together at least once with the recall asked for."""
    chance = 1.0
    for _ in range(50):
        chance = 1 - (1 - threshold * chance) ** fan
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingles(words(texts), width))


def _class(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, code, cls, size, sig): class key, number of distinct shingles and min-hashes of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("code"))
    return rows.mapInArrow(lambda batches: _signed(batches, width), f"doc_id {kind}, code bigint, cls binary, size bigint, sig binary")


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, size=SLICE):
            values, bounds = _sets(part.column("text"), width)
            full = np.flatnonzero(np.diff(bounds))
            sig = np.zeros((part.num_rows, COORDINATES), np.uint32)
            for k in range(COORDINATES if len(full) else 0):
                # a multiplication by an odd number and the upper bits order shingles anew
                turned = (values * np.uint64(int(_ODD[k]))) >> np.uint64(32)
                sig[full, k] = np.minimum.reduceat(turned, bounds[full])
            cls = [_class(values[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("code"), pa.array(cls, pa.binary()),
                 pa.array(np.diff(bounds)), pa.array([s.tobytes() for s in sig], pa.binary())],
                ["doc_id", "code", "cls", "size", "sig"])


_ODD = mixed(np.arange(COORDINATES, dtype=np.uint64), 41) | np.uint64(1)


def _children(nodes: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """FAN child nodes of each (node, class): the node's hash picks coordinates, the class's values there name the child."""
    out = np.empty((len(nodes), FAN), np.int64)
    at = np.arange(len(nodes))
    first = mixed(nodes.view(np.uint64), 1) % np.uint64(COORDINATES)
    stride = mixed(nodes.view(np.uint64), 2) % np.uint64(COORDINATES // FAN - 1) + np.uint64(1)
    for k in range(FAN):
        place = ((first + np.uint64(k) * stride) % np.uint64(COORDINATES)).astype(np.int64)
        value = sig[at, place].astype(np.uint64)
        out[:, k] = mixed(mixed(nodes.view(np.uint64), 5) ^ (value << np.uint64(8)) ^ place.astype(np.uint64), 6).view(np.int64)
    return out


def _split(rows: DataFrame, roots: list[int] | None = None) -> DataFrame:
    """(cls, sig[, node, members]) to (cls, node of a child, members above); without nodes every class stands in all roots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, COORDINATES)
            starts = [np.full(n, r, np.int64) for r in roots] if roots else [batch.column("node").to_numpy()]
            above = pa.nulls(n, pa.int64()) if roots else batch.column("members")
            for nodes in starts:
                made = _children(nodes, sig)
                for k in range(FAN):
                    yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(made[:, k]), above], ["cls", "node", "above"])

    return rows.mapInArrow(run, "cls binary, node bigint, above bigint")


def leaves(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(cls, node, members) of nodes to be compared by brute force, over all runs."""
    roots = mixed(np.arange(runs_for(threshold, recall), dtype=np.uint64), 77).view(np.int64).tolist()
    made, active = [], classes.select("cls", "sig")
    for level in range(DEPTH):
        placed = saved((_split(active, roots) if level == 0 else _split(active)).distinct(), "jaccard-nodes")
        counted = (placed.groupBy("node").agg(F.count("*").alias("members"), F.max("above").alias("above"))
                   .where("members > 1"))
        counted = saved(placed.drop("above").join(counted, "node").select("cls", "node", "members", "above"), "jaccard-shared")
        loose = F.col("members") <= TIGHT * F.coalesce("above", F.lit(1 << 62))
        large = F.lit(False) if level == DEPTH - 1 else (F.col("members") > SMALL) & loose
        made.append(counted.where(~large).select("cls", "node", "members"))
        rest = counted.where(large).select("cls", "node", "members")
        if not rest.take(1):
            break
        active = rest.join(classes.select("cls", "sig"), "cls").select("cls", "sig", "node", "members")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _cells(rows: DataFrame) -> DataFrame:
    """Cuts nodes into blocks of about BLOCK classes; (node, i, j, side) for every pair of blocks i <= j.

    Side 0 stands in block i, side 1 in block j; a class is copied once per
    block of its node, and no pair is made a row.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("cls", "node"), blocks).cast("int")
    return (rows.withColumn("blocks", blocks).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
            .withColumn("side", F.when(F.col("mine") == F.col("i"), 0).otherwise(1)).drop("blocks", "mine", "other", "members"))


def _owned(nodes: list[list[int]], node: int) -> np.ndarray:
    """Pairs whose smallest common node is this one: each pair is compared in one node only."""
    lower = [set(x for x in n if x < node) for n in nodes]
    places = {x: k for k, x in enumerate(sorted(set().union(*lower)))}
    if not places:
        return np.ones((len(nodes), len(nodes)), bool)
    held = np.zeros((len(nodes), len(places)), np.float32)
    for r, own in enumerate(lower):
        held[r, [places[x] for x in own]] = 1
    held = held[:, held.sum(0) > 1]
    return held @ held.T < 0.5


def _pairs(sides: np.ndarray, same_block: bool) -> np.ndarray:
    """Which (row, row) a cell is to compare: across its blocks, or all within one block."""
    n = len(sides)
    out = np.ones((n, n), bool) if same_block else sides[:, None] != sides[None, :]
    np.fill_diagonal(out, False)
    return out


def _candidates(threshold: float):
    agree = COORDINATES * threshold - SIGMAS * math.sqrt(COORDINATES * threshold * (1 - threshold))

    def act(cell: pa.Table) -> pa.Table | None:
        n = cell.num_rows
        if n < 2:
            return None
        sides, sizes = cell.column("side").to_numpy(), cell.column("size").to_numpy()
        same = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
        todo = _pairs(sides, same)
        if not todo.any():
            return None
        todo &= np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes)
        sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), np.uint32).reshape(n, COORDINATES)
        hits = np.zeros((n, n), np.int16)
        for k in range(COORDINATES):
            hits += sig[:, k, None] == sig[:, k]
        todo &= hits >= agree
        if todo.any():
            todo &= _owned(cell.column("nodes").to_pylist(), cell.column("node")[0].as_py())
        kept = np.flatnonzero(todo.any(1))
        return cell.select(["node", "i", "j", "side", "cls", "nodes"]).take(pa.array(kept)) if len(kept) else None

    return act


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products over the shingles that two sets or more hold."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    kept = counts[at] > 1
    rows, at = rows[kept], place[at[kept]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    width = 4096
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [low, low + width])
        held = np.zeros((len(sets), width), np.float32)
        held[rows[a:b], at[a:b] - low] = 1
        out += held @ held.T
    out = np.rint(out).astype(np.int64)
    out[np.diag_indices(len(sets))] = [len(s) for s in sets]
    return out


def _verified(threshold: float):
    def act(cell: pa.Table) -> pa.Table | None:
        sides = cell.column("side").to_numpy()
        todo = _pairs(sides, cell.column("i")[0].as_py() == cell.column("j")[0].as_py())
        todo &= _owned(cell.column("nodes").to_pylist(), cell.column("node")[0].as_py())
        sets = [np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        both = _shared(sets)
        close = todo & (both / (sizes[:, None] + sizes - both) >= threshold)
        if not close.any():
            return None
        cls, copies = cell.column("cls").to_pylist(), cell.column("copies").to_numpy()
        links = close @ copies
        rows = np.flatnonzero(links)
        edges = linked(close)
        return pa.table({
            "a": pa.array([cls[r] for r in rows] + [cls[x] for x, _ in edges], pa.binary()),
            "b": pa.array([None] * len(rows) + [cls[y] for _, y in edges], pa.binary()),
            "links": pa.array([*links[rows].tolist(), *[0] * len(edges)], pa.int64()),
            "texts": pa.array([*close[rows].sum(1).tolist(), *[0] * len(edges)], pa.int64())})

    return act


def _reread(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The shingles of the texts whose classes are compared."""
    for batch in batches:
        for part in slices(batch, size=SLICE):
            values, bounds = _sets(part.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("want"), part.column("copies"),
                 pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
                ["cls", "copies", "shingles"])


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """A row per document: key, code (hash of the text), class_id, copy_of, n_links, n_linked_texts.

    copy_of is the smallest key among the documents with an equal shingle set;
    class_id the smallest key that links reach. A link joins documents whose
    sets have a Jaccard similarity of at least ``threshold``; n_links counts a
    document's linked others, copies included, n_linked_texts the other sets.

    A text of fewer words than a shingle is one shingle; null and empty texts
    have the empty set and are copies of each other. Null keys take part, and
    name a class only if no other key does; repeated rows are copies. Empty
    tables give empty results; other columns are left out.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    told = saved(signatures(rows, width), "jaccard-signatures")
    classes = saved(told.groupBy("cls").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"),
                                            F.min(F.struct("doc_id", "code")).alias("first"), F.first("size").alias("size"),
                                            F.first("sig").alias("sig")), "jaccard-classes")
    at = saved(leaves(classes.where("size > 0"), threshold, recall), "jaccard-leaves")
    nodes = at.groupBy("cls").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    facts = nodes.join(classes.select("cls", "sig", "size"), "cls")
    shape = "node bigint, i int, j int, side int, cls binary, nodes array<bigint>"
    found = saved(by_group(_cells(at).join(facts, "cls"), ["node", "i", "j"], [], _candidates(threshold), shape), "jaccard-candidates")

    wanted = found.select("cls").distinct().join(classes, "cls").select("cls", "first.doc_id", "first.code", "copies")
    wanted = if_small(wanted.withColumnsRenamed({"cls": "want", "doc_id": "k", "code": "c"}))
    texts = (rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("k")) & (F.xxhash64(rows["text"]) == F.col("c")))
             .select("want", "copies", "text"))

    sets = texts.mapInArrow(lambda batches: _reread(batches, width), "cls binary, copies bigint, shingles binary").dropDuplicates(["cls"])
    checked = saved(by_group(found.join(sets, "cls"), ["node", "i", "j"], [], _verified(threshold),
                             "a binary, b binary, links bigint, texts bigint"), "jaccard-links")
    links = checked.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = components(checked.where("b is not null").select("a", "b"))
    part = (classes.select("cls", "copy_of", "copies").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
            .withColumn("root", F.coalesce("root", "cls")))
    least = part.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    known = part.join(least, "root").join(links, "cls", "left").select(
        "cls", "class_id", "copy_of", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts"))
    return told.select("doc_id", "code", "cls").join(known, "cls").select(
        F.col("doc_id").alias(key), "code", "class_id", "copy_of", "n_links", "n_linked_texts")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of every class: that of the smallest key, then of the smallest text hash. All columns stay."""
    found = join(docs, key=key, text=text, **settings)
    name, code = (fresh(c, docs.columns) for c in ("_key", "_code"))
    # a class whose documents all lack a key has no name; its copies share copy_of = null and a text hash each
    kept = (found.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("code")).alias("_own"))
            .agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "code")).alias("_kept"))
            .select(F.col("_kept.key").alias(name), F.col("_kept.code").alias(code)))
    held = docs.join(if_small(kept), docs[key].eqNullSafe(F.col(name)) & (F.xxhash64(docs[text]) == F.col(code)))
    return held.dropDuplicates([name, code]).select(*[docs[c] for c in docs.columns])
