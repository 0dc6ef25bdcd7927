"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of ASCII letters and digits and of characters beyond
ASCII, with A-Z lowered. With N documents that hold a term, L terms in all of
them, n terms of one document, df documents that hold a term and tf its
occurrences in one, all but the logarithm in 64-bit integers:

    w     = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))
    m     = 100 - 50 + (50 * n * N) div L
    score = sum over a query's distinct terms of w * ((1000000000 * tf) div (1000 * tf + 20 * m))

Documents of equal m are a stratum. A term's postings in it are kept by falling
tf, so an impact is computed once for every (stratum, term, tf), and a term's
best impact there is that of its first run. Their sum over a query's terms
bounds the score of every document of the stratum: strata are visited by
falling bounds, until the bound falls below the k-th best score found so far.

Strata are cut into blocks of at most ``DOCS`` documents and about ``POSTINGS``
postings, dealt by hash, so neither a common length nor a common text nor a
common term makes a hot task. Search tasks keep what they have found as bounds
over all blocks they read, and give k rows per query at most. The index holds
all terms of all documents and can be searched again. Terms are known by 64-bit
hashes. Queries are sent in batches of about ``QUERY_TERMS`` terms.

Rows: repeated rows and keys are documents of their own, and repeated queries
are each ranked. Null, empty and termless texts are not found, and termless
queries find nothing; empty tables give no rows. Equal scores go by ascending
key, null first. Extra columns of any name are allowed; keys may be texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import if_small, saved, shipped
from llm.words import slices, words

TOP = 50
DOCS = 1024
POSTINGS = 1 << 19
QUERY_TERMS = 500_000
VISIT = 64 << 20      # bytes of postings of asked terms whose blocks are ordered together


@dataclass
class Index:
    """rows: a row per block of a stratum; the key's type; N and L."""

    rows: DataFrame
    kind: str
    n_docs: int
    n_terms: int


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, written to the shared folder."""
    spark = docs.sparkSession
    shipped(spark)
    named = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    sizes = saved(named.select("text").mapInArrow(_sizes, "n bigint, docs bigint").groupBy("n").agg(F.sum("docs").alias("docs")), "lengths")
    total = sizes.agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    m = F.expr(f"100 - 50 + (50 * n * {n_docs}L) div {max(1, n_terms)}L")
    strata = sizes.groupBy(m.alias("m")).agg(F.ceil(F.sum("docs") / DOCS).alias("parts"))
    rows = named.mapInArrow(_terms, f"key {kind}, n bigint, terms binary, tfs binary").withColumn("m", m)
    dealt = rows.join(if_small(strata), "m").select(
        "m", F.pmod(F.xxhash64("key", "terms"), "parts").alias("part"), "key", "terms", "tfs")
    blocks = (dealt.repartition("m", "part").sortWithinPartitions("m", "part", "key", "terms")
              .mapInArrow(_blocks, f"m bigint, keys array<{kind}>, terms binary, runs binary, tfs binary, counts binary, docs binary"))
    return Index(saved(blocks, "index"), kind, n_docs, n_terms)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have how many terms."""
    for batch in batches:
        for part in slices(batch):
            n, docs = np.unique(np.diff(words(part.column("text"), plain=True).bounds), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n[n > 0], pa.int64()), pa.array(docs[n > 0], pa.int64())], ["n", "docs"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of every text in order, and how often each occurs."""
    for batch in batches:
        for part in slices(batch):
            found = words(part.column("text"), plain=True)
            keep = np.flatnonzero(np.diff(found.bounds))
            terms, tfs, cuts = counted(found.hashes, found.bounds)
            blobs = [[x[cuts[i]:cuts[i + 1]].tobytes() for i in keep] for x in (terms, tfs.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([
                part.column("key").take(pa.array(keep)), pa.array(np.diff(found.bounds)[keep], pa.int64()),
                *(pa.array(b, pa.binary()) for b in blobs)], ["key", "n", "terms", "tfs"])


def counted(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct terms of every text, their counts, and the bounds of the texts among them."""
    ordered = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        ordered[a:b].sort()
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    new[bounds[bounds < len(ordered)]] = True
    starts = np.flatnonzero(new)
    return ordered[starts], np.diff(np.append(starts, len(ordered))), np.searchsorted(starts, bounds)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs sorted documents of equal (m, part) into blocks."""
    at, held, size, kind = None, [], 0, None
    for batch in batches:
        kind = batch.schema.field("key").type
        for row in zip(*(batch.column(c).to_pylist() for c in ("m", "part", "key", "terms", "tfs"))):
            if held and (row[:2] != at or len(held) >= DOCS or size >= POSTINGS):
                yield _block(at[0], held, kind)
                held, size = [], 0
            at = row[:2]
            held.append(row[2:])
            size += len(row[3]) // 8
    if held:
        yield _block(at[0], held, kind)


def _block(m: int, held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """One row: per term its runs, per run its tf and documents; documents by number in key order."""
    terms = np.frombuffer(b"".join(t for _, t, _ in held), np.uint64)
    tfs = np.frombuffer(b"".join(t for _, _, t in held), "<i4")
    docs = np.repeat(np.arange(len(held)), [len(t) // 8 for _, t, _ in held])
    order = np.lexsort((-tfs, terms))
    terms, tfs, docs = terms[order], tfs[order], docs[order]
    new_term = np.ones(len(terms), bool)
    new_term[1:] = terms[1:] != terms[:-1]
    new_run = new_term.copy()
    new_run[1:] |= tfs[1:] != tfs[:-1]
    first = np.flatnonzero(new_run)
    runs = np.diff(np.append(np.flatnonzero(new_term[first]), len(first)))
    blobs = [terms[new_term], runs.astype("<i4"), tfs[first], np.diff(np.append(first, len(terms))).astype("<i4"), docs.astype("<u2")]
    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int64()), pa.array([[k for k, _, _ in held]], pa.list_(kind)), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)],
        ["m", "keys", "terms", "runs", "tfs", "counts", "docs"])


class _Stratum:
    """A block as far as the asked terms go."""

    def __init__(self, row: dict, keys: pa.Array, asked: np.ndarray, weights: np.ndarray | None):
        terms = np.frombuffer(row["terms"], np.uint64)
        at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
        self.asked = np.flatnonzero(terms[at] == asked)     # which of the asked terms the block holds
        at = at[self.asked]
        runs = np.frombuffer(row["runs"], "<i4").astype(np.int64)
        counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        first_run = np.cumsum(runs) - runs
        first_doc = np.append(0, np.cumsum(counts))
        a, b = first_doc[first_run[at]], first_doc[first_run[at] + runs[at]]
        self.df = b - a
        if weights is None:
            return
        self.keys = keys
        mine = np.concatenate([np.arange(x, x + n) for x, n in zip(first_run[at], runs[at])]) if len(at) else at
        tf = np.frombuffer(row["tfs"], "<i4").astype(np.int64)[mine]
        impacts = np.repeat(weights[self.asked], runs[at]) * ((1_000_000_000 * tf) // (1000 * tf + 20 * row["m"]))
        self.best = impacts[np.cumsum(runs[at]) - runs[at]]
        docs = np.frombuffer(row["docs"], "<u2")
        self.docs = np.concatenate([docs[x:y] for x, y in zip(a, b)]) if len(at) else docs[:0]
        self.impacts = np.repeat(impacts, counts[mine])
        self.cuts = np.append(0, np.cumsum(self.df))
        self.place = {t: i for i, t in enumerate(self.asked.tolist())}

    def nbytes(self) -> int:
        return self.docs.nbytes + self.impacts.nbytes + 256 * len(self.asked)

    def scores(self, terms: list[int]) -> np.ndarray:
        held = [self.place[t] for t in terms if t in self.place]
        spans = [(self.cuts[i], self.cuts[i + 1]) for i in held]
        docs = np.concatenate([self.docs[a:b] for a, b in spans])
        return np.bincount(docs, np.concatenate([self.impacts[a:b] for a, b in spans]), len(self.keys)).astype(np.int64)


@dataclass
class Batch:
    """Queries sent together: sorted distinct terms, and each query's terms by number."""

    keys: list
    asked: np.ndarray
    queries: list[np.ndarray]
    weights: np.ndarray | None = None


def _frequencies(batch):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = batch.value.asked
        df = np.zeros(len(asked), np.int64)
        for part in parts:
            for i in range(part.num_rows):
                block = _Stratum({c: part.column(c)[i].as_py() for c in part.schema.names}, None, asked, None)
                df[block.asked] += block.df
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held], pa.int64())], ["term", "df"])
    return run


def _searched(batch, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: Batch = batch.value
        found: list[list[tuple]] = [[] for _ in sent.queries]
        held, size, kind = [], 0, None
        for part in parts:
            kind = part.schema.field("keys").type.value_type
            for i in range(part.num_rows):
                row = {c: part.column(c)[i].as_py() for c in part.schema.names if c != "keys"}
                held.append(_Stratum(row, part.column("keys")[i].values, sent.asked, sent.weights))
                size += held[-1].nbytes()
                if size > VISIT:
                    visit(held, sent, k, found)
                    held, size = [], 0
        if held:
            visit(held, sent, k, found)
        rows = [(q, key, -score) for q, best in enumerate(found) for score, _, key in best]
        if rows:
            q, keys, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(keys, kind), pa.array(scores, pa.int64())], ["query", "key", "score"])
    return run


def visit(blocks: list[_Stratum], sent: Batch, k: int, found: list[list[tuple]]) -> int:
    """Adds to ``found`` (falling scores, then ascending keys) what blocks hold, by falling bounds; returns the visits."""
    best = np.zeros((len(blocks), len(sent.asked)), np.int64) if len(blocks) * len(sent.asked) < 1 << 22 else None
    bounds = np.empty((len(blocks), len(sent.queries)), np.int64)
    starts = np.cumsum([0, *(len(q) for q in sent.queries)])
    every = np.concatenate(sent.queries)
    for i, block in enumerate(blocks):
        row = best[i] if best is not None else np.zeros(len(sent.asked), np.int64)
        row[block.asked] = block.best
        bounds[i] = np.add.reduceat(row[every], starts[:-1])
    visits = 0
    for q, terms in enumerate(sent.queries):
        mine, numbers = found[q], terms.tolist()
        for i in np.argsort(-bounds[:, q], kind="stable"):
            least = -mine[k - 1][0] if len(mine) >= k else 1
            if bounds[i, q] < least:
                break
            visits += 1
            scores = blocks[i].scores(numbers)
            at = np.flatnonzero(scores >= least)
            at = at[np.argsort(-scores[at], kind="stable")[:k]]
            keys = blocks[i].keys.take(pa.array(at)).to_pylist()
            mine += [(-s, key is not None, key) for s, key in zip(scores[at].tolist(), keys)]
            mine.sort(key=lambda x: x if x[1] else x[:2])
            del mine[k:]
    return visits


def _batches(spark: SparkSession, queries: DataFrame, key: str, text: str) -> Iterator[Batch]:
    """Queries with terms, in batches of about QUERY_TERMS terms."""
    kind = queries.schema[key].dataType.simpleString()
    named = queries.select(queries[key].alias("key"), queries[text].cast("string").alias("text"))
    asked = saved(named.mapInArrow(_terms, f"key {kind}, n bigint, terms binary, tfs binary").select("key", "n", "terms"), "queries")
    count = math.ceil((asked.agg(F.sum("n")).first()[0] or 0) / QUERY_TERMS)
    for b in range(count):
        rows = asked.where(F.pmod(F.xxhash64("key", "terms"), F.lit(count)) == b).select("key", "terms").collect()
        if rows:
            every, at = np.unique(np.concatenate([np.frombuffer(r.terms, np.uint64) for r in rows]), return_inverse=True)
            cuts = np.cumsum([len(r.terms) // 8 for r in rows])[:-1]
            yield Batch([r.key for r in rows], every, np.split(at, cuts))


def search(index: Index, queries: DataFrame, k: int = TOP, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, rank, doc, score: the k best documents of every query with a score above 0."""
    spark = queries.sparkSession
    shipped(spark)
    kind = queries.schema[key].dataType.simpleString()
    out = None
    for sent in _batches(spark, queries, key, text):
        packed = spark.sparkContext.broadcast(sent)
        counts = index.rows.select("terms", "runs", "counts").mapInArrow(_frequencies(packed), "term bigint, df bigint")
        df = np.zeros(len(sent.asked), np.int64)
        for row in counts.groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row.term] = row.df
        sent.weights = np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * df + 1))).astype(np.int64)
        weighed = spark.sparkContext.broadcast(sent)
        found = index.rows.mapInArrow(_searched(weighed, k), f"query bigint, key {index.kind}, score bigint")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(sent.keys)), f"query bigint, named {kind}")
        rows = best.join(F.broadcast(named), "query").select(
            F.col("named").alias(key), "rank", F.col("key").alias("doc"), "score")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], f"`{key}` {kind}, rank int, doc {index.kind}, score bigint")
