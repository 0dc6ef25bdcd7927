"""I-Match fingerprints: hashes of the terms of a text that lie in a band of inverse document frequency.

The lexicon holds the terms whose document frequency is a share of all
documents within a band. Since a text has few distinct terms on average, at
most (mean distinct terms) / (least share) terms can reach the least share, so
the lexicon's size does not grow with the number of documents.

A fingerprint is the hash of all distinct lexicon terms of a text, in order,
and hashes of its terms in ``SUBSETS`` random subsets of the lexicon. Subsets
keep terms at rates from 1/8 down to 1/1024: a text of any length has subsets
of which it holds only a term or a few, and those survive an edit elsewhere.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import saved
from llm.words import distinct, mixed, slices, words

BAND = (2e-5, 0.05)  # least and largest share of documents that hold a term
LEAST = 2            # and at least so many documents
RATES = [2.0 ** -k for k in range(3, 11)]
DRAWS = 8
SUBSETS = len(RATES) * DRAWS
# a lexicon of more terms than this bound means texts of more than BOUND * BAND[0] distinct terms on average
BOUND = 4_000_000


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term hash, documents that hold it) over all documents; partial counts are made per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in slices(batch):
                found = words(part.column("text"))
                terms, _ = distinct(found.hashes, found.bounds)
                held.append(np.unique(terms, return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held, size = [_merged(held)], 0
                    if len(held[0][0]) > 1_000_000:
                        yield _counts(*held.pop())
        if held:
            yield _counts(*_merged(held))

    return (docs.select(docs[text].alias("text")).mapInArrow(run, "term bigint, n bigint")
            .groupBy("term").agg(F.sum("n").alias("n")))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([n for _, n in held]), len(terms)).astype(np.int64)
    return terms, counts


def _counts(terms: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], ["term", "n"])


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> np.ndarray:
    """Sorted hashes of the terms in the band; bounded as the module says, and checked."""
    n = docs.count()
    kept = term_counts(docs, text).where(F.col("n").between(max(LEAST, band[0] * n), max(LEAST, band[1] * n)))
    rows = kept.select("term").limit(BOUND + 1).toPandas()["term"].to_numpy(np.int64)
    if len(rows) > BOUND:
        raise ValueError("the texts have too many distinct terms for this band: raise its lower end")
    return np.sort(rows.view(np.uint64))


class Fingerprints:
    """Fingerprints of batches of texts under a lexicon. The draws depend on the term and a seed only."""

    def __init__(self, terms: np.ndarray, seed: int = 7):
        self.terms = terms
        at, subsets = [], []
        for s in range(SUBSETS):
            drawn = np.flatnonzero(mixed(terms, seed * 1000 + s) < np.uint64(int(RATES[s // DRAWS] * 2**64)))
            at.append(drawn)
            subsets.append(np.full(len(drawn), s, np.int64))
        at, subsets = np.concatenate(at), np.concatenate(subsets)
        order = np.argsort(at, kind="stable")
        self.subsets = subsets[order]
        self.first = np.searchsorted(at[order], np.arange(len(terms) + 1))

    def of(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Fingerprint strings and the 64-bit hashes of the subsets, 0 where a text has no term of a subset."""
        found = words(texts)
        held, bounds = distinct(found.hashes, found.bounds)
        n = len(texts)
        place = np.minimum(np.searchsorted(self.terms, held), max(0, len(self.terms) - 1))
        inside = self.terms[place] == held if len(self.terms) else np.zeros(len(held), bool)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        # a text without lexicon terms is told by all its terms
        lone = np.bincount(doc[inside], minlength=n) == 0
        picked = inside | lone[doc]
        terms, of = held[picked], doc[picked]
        cuts = np.searchsorted(of, np.arange(n + 1))
        whole = [hashlib.sha1(terms[a:b].tobytes()).hexdigest()[:16] for a, b in zip(cuts, cuts[1:])]
        sums = np.zeros(n * SUBSETS, np.uint64)
        place, of = place[inside], doc[inside]
        sizes = self.first[place + 1] - self.first[place]
        rows = np.repeat(np.arange(len(place)), sizes)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        np.add.at(sums, of[rows] * SUBSETS + self.subsets[self.first[place[rows]] + nth],
                  mixed(self.terms[place[rows]], 99))
        sums = sums.reshape(n, SUBSETS)
        short = (mixed(sums) & np.uint64(0xFFFFFF)).astype(np.int64)
        shown = np.char.mod("%06x", short)
        shown[sums == 0] = "-"
        return [w + ":" + ",".join(s) for w, s in zip(whole, shown.tolist())], sums


def likeness(a_text: list[str], a: np.ndarray, b_text: list[str], b: np.ndarray) -> np.ndarray:
    """Share of subsets with equal hashes among those of which either text has a term; equal fingerprints: 1."""
    either = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    equal = np.array([x == y for x, y in zip(a_text, b_text)], bool)
    return np.where(equal, 1.0, same / np.maximum(either, 1))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(key, fingerprint) of every text.

    Equal texts have equal fingerprints; so have texts that differ only in the
    case, order or number of words. A text without a term in the band is told by all
    its terms; a null text counts as empty. Rows keep null and repeated keys;
    other columns are left out. No row meets another but in the term counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text, band))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Fingerprints(sent.value)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(made.of(part.column("text"))[0])],
                                                 [key, "fingerprint"])

    return (docs.select(docs[key].alias("key"), docs[text].alias("text"))
            .mapInArrow(run, f"`{key}` {kind}, fingerprint string"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text",
                        band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are.

    The edited text has its last half (rounded down, in code points) replaced by
    as many first code points of the next row in key order, or all of them; the
    last row is followed by the first. Null keys come first; rows of one key are
    ordered by the hash of their text. Columns: key, n_chars, edited, fingerprint,
    edited_fingerprint, near_edited, near_next. One row alone follows itself.

    Rows are sorted in ranges of keys cut at quantiles, of a bounded sample if keys are texts; each range streams
    through a task with one row held back, and the first row of every range is
    kept aside for the end of the range before it.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(lexicon(rows, "text", band))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(rows, parts)
    at = spark.sparkContext.broadcast(cuts)
    rows = rows.withColumn("code", F.xxhash64("text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_ranges(batch.column("key"), at.value)), *batch.columns], ["range", "k", "c"])

    placed = rows.select("key", "code").mapInArrow(place, f"range int, k {kind}, c bigint")
    least = placed.groupBy("range").agg(F.min(F.struct("k", "c")).alias("row")).select("range", "row.*")
    firsts = saved(rows.join(F.broadcast(least), F.col("key").eqNullSafe(F.col("k")) & (F.col("code") == F.col("c")))
                   .select("range", "key", "code", "text").dropDuplicates(["range"]), "imatch-firsts")
    begins = [r.range for r in firsts.select("range").orderBy("range").collect()]
    follow = spark.createDataFrame(list(zip(begins[1:] + begins[:1], begins)), "range int, before int")
    heads = firsts.join(F.broadcast(follow), "range").select(F.col("before").alias("range"), F.lit(1).alias("last"), "key", "code", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Fingerprints(sent.value)
        held = None
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed in slices(batch, "packed", 1 << 20):
                texts = pa.array([open_.decompress(b).decode() for b in packed.column("packed").to_pylist()], pa.string())
                whole = pa.RecordBatch.from_arrays([packed.column("key"), texts, packed.column("last")], ["key", "text", "last"])
                for part in slices(whole, size=2 << 20):
                    if held is not None:
                        part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                    # a copy, so that the row held back does not keep its batch
                    held = part.take(pa.array([part.num_rows - 1]))
                    if part.num_rows > 1:
                        yield _compared(made, part, key)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are shuffled compressed; the stream codec alone leaves them half as large again."""
        close = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ranges = pc.coalesce(batch.column("range"), pa.array(_ranges(batch.column("key"), at.value)))
            packed = pa.array([close.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([ranges, *[batch.column(c) for c in ("last", "key", "code")], packed],
                                             ["range", "last", "key", "code", "packed"])

    whole = (rows.select(F.lit(None).cast("int").alias("range"), F.lit(0).alias("last"), "key", "code", "text").unionByName(heads)
             .mapInArrow(pack, f"range int, last int, key {kind}, code bigint, packed binary"))
    shape = (f"`{key}` {kind}, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
    return (whole.repartition("range").sortWithinPartitions("range", "last", "key", "code", "packed")
            .mapInArrow(run, shape))


def _cuts(rows: DataFrame, parts: int) -> np.ndarray | list[str]:
    """Sorted quantiles of the keys."""
    if rows.schema["key"].dataType.simpleString() == "string":
        drawn = rows.select("key").where("key IS NOT NULL").distinct().orderBy(F.xxhash64("key")).limit(50 * parts)
        keys = sorted(r.key for r in drawn.collect())
        return sorted({keys[k * len(keys) // parts] for k in range(1, parts)}) if keys else []
    cuts = rows.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 20 * parts).alias("c")).first().c or []
    return np.array(sorted(set(cuts)))


def _ranges(keys: pa.Array, cuts: np.ndarray | list[str]) -> np.ndarray:
    """The range of every key between sorted cuts; null keys are in the first."""
    out = np.zeros(len(keys), np.int32)
    if isinstance(cuts, list):
        return np.array([0 if k is None else bisect_right(cuts, k) for k in keys.to_pylist()], np.int32)
    if len(cuts):
        out[keys.is_valid().to_numpy(zero_copy_only=False)] = np.searchsorted(
            cuts, keys.drop_null().to_numpy(zero_copy_only=False), side="right")
    return out


def _compared(made: Fingerprints, part: pa.RecordBatch, key: str) -> pa.RecordBatch:
    """Every row but heads (last = 1) with the row behind it."""
    own = np.flatnonzero(part.column("last").to_numpy() == 0)
    own = own[own < part.num_rows - 1]
    texts = part.column("text").to_pylist()
    edited = [texts[i][:len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][:len(texts[i]) // 2] for i in own]
    shown, sums = made.of(part.column("text"))
    edited_shown, edited_sums = made.of(pa.array(edited, pa.string()))
    mine, next_ = [shown[i] for i in own], [shown[i + 1] for i in own]
    columns = [part.column("key").take(pa.array(own)), pa.array([len(texts[i]) for i in own], pa.int64()),
               pa.array(edited, pa.string()), pa.array(mine, pa.string()), pa.array(edited_shown, pa.string()),
               pa.array(likeness(mine, sums[own], edited_shown, edited_sums), pa.float64()),
               pa.array(likeness(mine, sums[own], next_, sums[own + 1]), pa.float64())]
    names = [key, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays(columns, names)
