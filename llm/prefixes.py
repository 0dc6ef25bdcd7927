"""The prefix trie of conversations by a splitter skeleton.

A conversation becomes a path: one 128-bit digest per turn, of its role and
text, with the words of each turn beside it. Equal paths are counted before
anything is sorted. Paths are dealt to shards by splitters, which are quantiles
of a bounded sample of paths, cut after ``DEPTH`` turns. If two paths of
different shards share a prefix, the splitter between them has it too; so all
nodes but the prefixes of splitters, the skeleton, lie in one shard. The
skeleton (at most ``DEPTH`` nodes per splitter) is broadcast. Every shard sorts
its paths and finishes its own nodes with a stack, as deep as a path; for
skeleton nodes it emits partial aggregates, which are summed by node and then
over the skeleton.

A node is a distinct sequence of first turns; the root has none. Conversations
that share more than ``DEPTH`` turns lie in one shard, whose rows are distinct
paths; results do not depend on it.

Rows: turns are ordered by the turn column, null first, equal turns by digest,
so repeated rows are repeated turns. Null roles and texts count as empty. Rows
with a null key belong to no conversation. An empty table gives no nodes. Extra
columns of any name are allowed, and keys of any type that can be ordered.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import saved, shipped

DIGEST = 16       # bytes of a turn's digest
COUNT = 8         # bytes of a turn's number of words
DEPTH = 64        # turns of a splitter
SAMPLE = 32       # sampled paths per shard
TURNS = 1 << 16   # turns of a piece of a conversation that is put together elsewhere
IDS = 1 << 16     # keys of a piece of a list
NOTHING = hashlib.sha256(b"").hexdigest()


def paths(convs: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, path, words): digests and word counts of all turns in order, packed; a row per conversation.

    A conversation may hold any share of the turns: ranges of (key, turn) are
    packed where they lie, and only packed pieces meet.
    """
    shipped(convs.sparkSession)
    said = [F.coalesce(convs[c].cast("string"), F.lit("")) for c in (role, text)]
    turns = convs.where(convs[key].isNotNull()).select(
        convs[key].alias("conv"), convs[turn].alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said))).alias("digest"),
        F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    kind = turns.schema["conv"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, rest = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(["conv", "digest", "words"])
            rest = rows if rest is None else pa.concat_tables([rest, rows])
            cuts = _changes(rest.column("conv"))
            done = len(cuts) - 1 if len(cuts) > 1 else int(rest.num_rows >= TURNS)
            if done:
                yield _pieces(rest, cuts[:done + 1] if len(cuts) > 1 else [0, rest.num_rows], part, seq)
                seq += done
                rest = rest.slice(cuts[-1]) if len(cuts) > 1 else None
        if rest is not None and rest.num_rows:
            yield _pieces(rest, [*_changes(rest.column("conv")), rest.num_rows], part, seq)

    pieces = (turns.repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(packed, f"conv {kind}, part int, seq bigint, path binary, words binary"))
    parts = F.sort_array(F.collect_list(F.struct("part", "seq", "path", "words")))
    joined = "aggregate(parts, X'', (all, p) -> concat(all, p.{0})) AS {0}"
    return pieces.groupBy("conv").agg(parts.alias("parts")).selectExpr("conv", joined.format("path"), joined.format("words"))


def _changes(column: pa.ChunkedArray) -> list[int]:
    """Where a new value begins."""
    values = column.combine_chunks()
    if len(values) < 2:
        return [0] * len(values)
    differs = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(differs) + 1).tolist()]


def _pieces(rows: pa.Table, cuts: list[int], part: int, seq: int) -> pa.RecordBatch:
    """One packed row for every run of rows between cuts."""
    runs = len(cuts) - 1
    used = rows.slice(0, cuts[-1])
    digests = b"".join(used.column("digest").to_pylist())
    words = used.column("words").to_numpy().astype("<i8").tobytes()
    return pa.RecordBatch.from_arrays([
        used.column("conv").combine_chunks().take(pa.array(cuts[:-1], pa.int64())), pa.array([part] * runs, pa.int32()),
        pa.array(range(seq, seq + runs), pa.int64()),
        pa.array([digests[a * DIGEST:b * DIGEST] for a, b in zip(cuts, cuts[1:])], pa.binary()),
        pa.array([words[a * COUNT:b * COUNT] for a, b in zip(cuts, cuts[1:])], pa.binary())], ["conv", "part", "seq", "path", "words"])


def _ends(found: DataFrame) -> DataFrame:
    """(id, ends): SHA-256 of the ascending keys of every path, comma-joined.

    Ranges of (path, key) are joined where they lie; the digest of a path reads its pieces in order.
    """
    kind = found.schema["conv"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held = None, None, []
        made: list[tuple] = []
        for batch in batches:
            for name, conv in zip(batch.column("id").to_pylist(), batch.column("conv").to_pylist()):
                if name != at or len(held) >= IDS:
                    if held:
                        made.append((at, first, ",".join(held)))
                    at, first, held = name, conv, []
                held.append(str(conv))
            if made:
                yield _rows(made, batch.schema.field("conv").type)
                made = []
        if held:
            yield _rows([(at, first, ",".join(held))], batch.schema.field("conv").type)

    def _rows(made: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        ids, firsts, lists = zip(*made)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(firsts, key), pa.array(lists, pa.string())], ["id", "first", "list"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            ids, ends = [], []
            for name, part in zip(batch.column("id").to_pylist(), batch.column("list").to_pylist()):
                if name != at:
                    if state is not None:
                        ids.append(at)
                        ends.append(state.hexdigest())
                    at, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(ends, pa.string())], ["id", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends"])

    lists = (found.select("id", "conv").repartitionByRange("id", "conv").sortWithinPartitions("id", "conv")
             .mapInArrow(listed, f"id binary, first {kind}, list string"))
    return lists.repartition("id").sortWithinPartitions("id", "first").mapInArrow(hashed, "id binary, ends string")


def _splitters(distinct: DataFrame, shards: int) -> list[bytes]:
    """Quantiles of a bounded sample of the paths, cut after DEPTH turns, in order."""
    drawn = distinct.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(SAMPLE * shards)
    heads = sorted(bytes(r.head) for r in drawn.select(F.substring("path", 1, DIGEST * DEPTH).alias("head")).collect())
    return sorted({heads[k * len(heads) // shards] for k in range(1, shards)} - {b""}) if heads else []


def _skeleton(cuts: list[bytes]) -> dict[bytes, bytes | None]:
    """The node of every prefix of a splitter, and the node above it; the root is always among them."""
    bones: dict[bytes, bytes | None] = {hashlib.md5().digest(): None}
    for cut in cuts:
        state = hashlib.md5()
        for at in range(0, len(cut), DIGEST):
            above = state.digest()
            state.update(cut[at:at + DIGEST])
            bones.setdefault(state.digest(), above)
    return bones


class _Node:
    __slots__ = ("state", "id", "depth", "words", "first", "n_convs", "n_children", "n_leaves", "saved", "ends", "below")

    def __init__(self, state, depth: int, words: int):
        self.state, self.id, self.depth, self.words = state, state.digest(), depth, words
        self.first, self.n_convs, self.n_children, self.n_leaves, self.saved, self.ends = None, 0, 0, 0, 0, None
        self.below: list[tuple] = []  # finished nodes just below, which wait for this node's smallest key


FIELDS = "bone boolean, id binary, parent binary, {0}depth bigint, {1}n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, words bigint, ends string"


def _sharded(kind: str, bones: set[bytes]):
    """Streams sorted paths of shards; gives finished nodes and partial aggregates of skeleton nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Node] = []
        out: list[tuple] = []
        shard, before, key = None, b"", None

        def close() -> None:
            node = stack.pop()
            out.extend((False, row[0], node.id, row[1], row[2], node.first, *row[3:]) for row in node.below)
            above = stack[-1] if stack else None
            if above is not None:
                above.n_convs += node.n_convs
                above.first = node.first if above.first is None else min(above.first, node.first)
            if node.id in bones:
                out.append((True, node.id, above and above.id, node.first, node.depth, None, node.n_convs, node.n_children, node.n_leaves,
                            node.saved, node.words, node.ends))
                return
            node.n_leaves = node.n_leaves or 1
            node.saved += (node.n_convs - 1) * node.words
            above.n_children += 1
            above.n_leaves += node.n_leaves
            above.saved += node.saved
            row = (node.id, node.first, node.depth, node.n_convs, node.n_children, node.n_leaves, node.saved, node.words, node.ends)
            if above.id in bones:
                out.append((False, row[0], above.id, row[1], row[2], None, *row[3:]))
            else:
                above.below.append(row)

        for batch in batches:
            key = batch.schema.field("first").type
            for at, path, words, first, n, ends in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "words", "first", "n", "ends"))):
                if at != shard:
                    while stack:
                        close()
                    shard, before = at, b""
                    stack.append(_Node(hashlib.md5(), 0, 0))
                same, most = 0, min(len(path), len(before))
                while same < most and path[same:same + DIGEST] == before[same:same + DIGEST]:
                    same += DIGEST
                while stack[-1].depth > same // DIGEST:
                    close()
                counts = np.frombuffer(words, "<i8").tolist()
                for depth in range(same // DIGEST, len(path) // DIGEST):
                    state = stack[-1].state.copy()
                    state.update(path[depth * DIGEST:(depth + 1) * DIGEST])
                    stack.append(_Node(state, depth + 1, counts[depth]))
                node, before = stack[-1], path
                node.n_convs += n
                node.first = first if node.first is None else min(node.first, first)
                node.ends = ends
                if len(out) >= 4096:
                    yield _emitted(out, key)
                    out.clear()
        while stack:
            close()
        if out:
            yield _emitted(out, key)

    def _emitted(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.bool_(), pa.binary(), pa.binary(), key, pa.int64(), key, *[pa.int64()] * 5, pa.string()]
        names = [f.split()[0] for f in FIELDS.format("conv x, ", "parent_conv x, ").split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run, FIELDS.format(f"conv {kind}, ", f"parent_conv {kind}, ")


def nodes(found: DataFrame) -> DataFrame:
    """The trie of paths (conv, path, words), a row per node.

    node, parent (digests; the root has no parent), conv_id (the smallest member),
    depth, parent_conv_id (the parent's smallest member), n_convs (conversations
    that begin with the node), n_children, n_leaves (childless nodes of the subtree,
    itself included), saved_tokens (over the subtree, words of a node's last turn
    times its members but one), ends_sha256 (of the ascending keys of those that
    end here, comma-joined).
    """
    spark = found.sparkSession
    shipped(spark)
    kind = found.schema["conv"].dataType.simpleString()
    found = saved(found.select("conv", "path", "words", F.unhex(F.md5("path")).alias("id")), "paths")
    counted = found.groupBy("id").agg(F.max("path").alias("path"), F.max("words").alias("words"), F.min("conv").alias("first"),
                                      F.count("*").alias("n"))
    distinct = saved(counted.join(_ends(found), "id"), "distinct-paths")
    cuts = _splitters(distinct, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bones = _skeleton(cuts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = [bisect_right(cuts, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    columns = f"path binary, words binary, first {kind}, n bigint, ends string"
    shards = distinct.select("path", "words", "first", "n", "ends").mapInArrow(dealt, f"shard int, {columns}")
    run, schema = _sharded(kind, set(bones))
    parts = saved(shards.repartition("shard").sortWithinPartitions("shard", "path").mapInArrow(run, schema), "trie-parts")

    total = _reduced(parts, bones)
    above = total.select(F.col("id").alias("parent"), F.col("conv").alias("above"))
    rows = parts.where("NOT bone").select("id", "parent", "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends")
    every = rows.unionByName(total.withColumn("parent_conv", F.lit(None).cast(kind)))
    return every.join(F.broadcast(above), "parent", "left").select(
        F.lower(F.hex("id")).alias("node"), F.lower(F.hex("parent")).alias("parent"), F.col("conv").alias("conv_id"), "depth",
        F.coalesce("parent_conv", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def _reduced(parts: DataFrame, bones: dict[bytes, bytes | None]) -> DataFrame:
    """Skeleton nodes: partial aggregates of the shards summed by node, then over the skeleton below each node.

    A table of at most (shards - 1) * DEPTH + 1 rows, saved.
    """
    spark = parts.sparkSession
    lines = []
    for bone, above in bones.items():
        over, at = [bone], above
        while at is not None:
            over.append(at)
            at = bones[at]
        lines.append((bone, above, over))
    tree = spark.createDataFrame(lines, "id binary, parent binary, over array<binary>")
    own = parts.where("bone").groupBy("id").agg(
        F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below"), F.max("words").alias("words"), F.max("ends").alias("ends"))
    inner = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("inner"))
    joined = saved(own.join(F.broadcast(tree), "id").join(F.broadcast(inner), "id", "left").select(
        "id", "parent", "over", "conv", "depth", "n_convs", "ends", (F.col("children") + F.coalesce("inner", F.lit(0))).alias("n_children"),
        "leaves", (F.col("below") + (F.col("n_convs") - 1) * F.col("words")).alias("saved")), "skeleton")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = (joined.select(F.explode("over").alias("id"), (F.col("leaves") + leaf).alias("leaves"), "saved")
            .groupBy("id").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved")))
    return saved(joined.drop("over", "leaves", "saved").join(F.broadcast(sums), "id")
                 .select("id", "parent", "conv", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"), "skeleton")


def trie(convs: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``nodes`` of the conversations as they stand."""
    return nodes(paths(convs, key, turn, role, text))
