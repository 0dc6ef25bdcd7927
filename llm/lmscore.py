"""Cross-entropy difference of two matched n-gram models.

Both models are bigram models over one vocabulary, with the same smoothing: the
target model counts the texts marked as target, the background model counts all
texts. The loss of a token under a model is -ln p(w | h), with

    p(w)     = (c(w) + ALPHA) / (N + ALPHA * V)
    p(w | h) = (c(h, w) + MU * p(w)) / (c(h) + MU)

where h is the word before, or the start of the text. A text's score is the
mean over its tokens of target loss minus background loss: low is like the
target. Words are lower-case runs without white space.

The vocabulary is every word that occurs at least ``LEAST`` times, however many
there are; other words are one word, "unknown". Neither words nor bigrams are
gathered: texts are cut into slices, every slice asks for the totals of its
distinct words and then of its distinct bigrams, packed by hash into homes of
about ``HOME`` questions each, and sums the losses of its own texts. A hot word
or bigram is one question per slice. An answer is what other slices add, mostly
nothing. Questions grow with slices times homes only until each holds one.
Words and bigrams are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import acted, by_group, if_small, saved
from llm.words import mixed, slices, words

LEAST = 2
ALPHA = 0.5
MU = 8.0
START, UNKNOWN = 0, 1  # in the place of a word's hash
HOME = 1 << 20         # questions answered together
SLICE = 8 << 20        # bytes of text asked for together
PART = 2 << 20         # bytes of text split into words at a time


def with_target(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, text) with boolean target: whether the key is in ``marks`` (doc_id).

    Marks are broadcast if they are few; otherwise the shuffled join is written
    once, so that later steps see its rows in one order.
    """
    marks = marks.where("doc_id is not null").select(F.col("doc_id").alias("_mark")).distinct()
    small = if_small(marks)
    rows = (docs.join(small, docs["doc_id"] == F.col("_mark"), "left")
            .select(docs["doc_id"], docs["text"], F.col("_mark").isNotNull().alias("target")))
    return saved(rows, "lm-texts") if small is marks else rows


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, tokens in target, tokens in all) of the columns text and target; counted per task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part in slices(batch):
                found = words(part.column("text"))
                marked = np.repeat(part.column("target").to_numpy(zero_copy_only=False), np.diff(found.bounds))
                held.append(_summed(found.hashes, marked.astype(np.int64), np.ones(len(marked), np.int64)))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > 750_000:
                        yield _batch(held.pop())
                        size = 0
        if held:
            yield _batch(_summed(*map(np.concatenate, zip(*held))))

    return (docs.mapInArrow(run, "word bigint, target bigint, n bigint").groupBy("word")
            .agg(F.sum("target").alias("target"), F.sum("n").alias("n")))


def _summed(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, a, len(own)).astype(np.int64), np.bincount(at, b, len(own)).astype(np.int64)


def _batch(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), pa.array(rows[1]), pa.array(rows[2])],
                                      ["word", "target", "n"])


@dataclass
class Sums:
    """Of the target and of all texts: texts, tokens, and tokens of unknown words; size: words with the unknown one."""

    texts: tuple[int, int]
    tokens: tuple[int, int]
    unknown: tuple[int, int]
    size: int


def sums(docs: DataFrame, least: int = LEAST) -> Sums:
    """Of the columns text and target."""
    known = F.col("n") >= least
    total = lambda c, *when: F.coalesce(F.sum(F.when(when[0], F.col(c)) if when else F.col(c)), F.lit(0))
    row = word_counts(docs).agg(total("target"), total("n"), total("target", ~known), total("n", ~known), F.count(F.when(known, 1))).first()
    texts = docs.agg(F.count(F.when(F.col("target"), 1)), F.count("*")).first()
    return Sums(tuple(texts), tuple(row[:2]), tuple(row[2:4]), row[4] + 1)


CELLS = ["words", "at", "bounds", "marked"]
SLICED = "slice bigint, " + ", ".join(f"{c} binary" for c in CELLS)
ASKED = "home bigint, slice bigint, hashes binary, target binary, n binary"


def score(docs: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """key, n_tokens, target_loss, background_loss (means per token), score for every row.

    ``marks`` holds the keys of the target texts; a null key is no target. A
    null or empty text has 0 tokens, and null losses and score. Repeated rows
    count as often as they stand there and get equal scores; an empty table
    gives an empty result; without target texts the target model is the uniform
    one. Whole texts are counted and scored.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = with_target(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")),
                       marks.select(F.col(key).alias("doc_id")))
    model = sums(rows.select("text", "target"), least)
    homes = -(-model.tokens[1] // HOME) or 1
    cut = saved(rows.mapInArrow(_slices, f"{SLICED}, keys array<{kind}>"), "lm-slices")
    asked = cut.select("slice", *CELLS).mapInArrow(lambda batches: _asked_words(batches, homes), ASKED)
    words_told = saved(_answered(asked), "lm-words")
    # slices with the answers about their words are shuffled once, for the questions about bigrams and for the losses
    known = cut.unionByName(words_told, allowMissingColumns=True).repartition("slice")
    asked = acted(known, ["slice"], ["home"], lambda group: _asked_pairs(group, homes, least), ASKED)
    pairs_told = _answered(asked)
    summed = known.groupBy("slice").cogroup(pairs_told.groupBy("slice")).applyInArrow(
        lambda group, pairs: _gathered(group, pairs, homes, least, model),
        f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double")
    return summed.select(F.col("doc_id").alias(key), "n_tokens", "target_loss", "background_loss",
                         (F.col("target_loss") - F.col("background_loss")).alias("score"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of texts: their distinct words, and for every token which of them it is."""
    task, nth = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch, size=SLICE):
            found = [words(piece.column("text")) for piece in slices(part, size=PART)]
            own, at = np.unique(np.concatenate([f.hashes for f in found]), return_inverse=True)
            tokens = np.concatenate([np.diff(f.bounds) for f in found])
            marked = part.column("target").to_numpy(zero_copy_only=False).astype(np.uint8)
            cells = [own, at.astype(np.int32), np.concatenate([[0], np.cumsum(tokens)]).astype(np.int64), marked]
            named = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | nth], pa.int64()), *[pa.array([_packed(c)], pa.binary()) for c in cells], named],
                ["slice", *CELLS, "keys"])
            nth += 1


def _packed(x: np.ndarray) -> bytes:
    """Compressed, first bytes of all numbers first, behind the size."""
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _read(rows: pa.Table | pa.RecordBatch, k: int, name: str, kind: type) -> np.ndarray:
    cell = rows.column(name)[k].as_buffer()
    size = int.from_bytes(cell[:8], "little")
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(cell.slice(8), size, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@dataclass
class Slice:
    """words: the distinct words; at: which of them every token is; bounds: of the texts' tokens; marked: tokens of target texts."""

    words: np.ndarray
    at: np.ndarray
    bounds: np.ndarray
    marked: np.ndarray

    @staticmethod
    def read(rows: pa.Table | pa.RecordBatch, k: int) -> Slice:
        bounds = _read(rows, k, "bounds", np.int64)
        return Slice(_read(rows, k, "words", np.uint64), _read(rows, k, "at", np.int32), bounds,
                     np.repeat(_read(rows, k, "marked", np.uint8), np.diff(bounds)))

    def counts(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of target texts and of all texts by thing, for the things ``at`` of the tokens."""
        return np.bincount(at, self.marked, size).astype(np.int64), np.bincount(at, minlength=size).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct bigrams, and which of them ends at every token."""
        w = self.words[self.at]
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[self.bounds[:-1][np.diff(self.bounds) > 0]] = START
        return np.unique(mixed(mixed(h, 31) + w, 32), return_inverse=True)


def _questions(number: int, things: np.ndarray, counts: tuple[np.ndarray, np.ndarray], homes: int) -> list[pa.Array]:
    """A slice's things and its own counts of them, a row per home."""
    order, home = _homes(things, homes)
    at_home = np.flatnonzero(np.diff(home, prepend=-1))
    spans = list(zip(at_home, [*at_home[1:], len(things)]))
    cells = [[_packed(np.diff(things[order][a:b], prepend=np.uint64(0))) for a, b in spans],
             *[[_packed(c.astype(np.int32)[order][a:b]) for a, b in spans] for c in counts]]
    return [pa.array(home[at_home], pa.int64()), pa.array([number] * len(at_home), pa.int64()), *[pa.array(c, pa.binary()) for c in cells]]


ASKED_NAMES = ["home", "slice", "hashes", "target", "n"]


def _asked_words(batches: Iterator[pa.RecordBatch], homes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            own = Slice.read(batch, k)
            rows = _questions(batch.column("slice")[k].as_py(), own.words, own.counts(own.at, len(own.words)), homes)
            yield pa.RecordBatch.from_arrays(rows, ASKED_NAMES)


def _answered(asked: DataFrame) -> DataFrame:
    """(home, slice, target, n): what all other slices count of a slice's things, in the order of home and hash."""
    def answer(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_read(group, k, "hashes", np.uint64), dtype=np.uint64) for k in range(group.num_rows)]
        target, n = (np.concatenate([_read(group, k, c, np.int32) for k in range(group.num_rows)]) for c in ("target", "n"))
        ends = np.cumsum([len(x) for x in keys])[:-1]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        cells = [[_packed(x) for x in np.split(np.bincount(at, c).astype(np.int64)[at] - c, ends)] for c in (target, n)]
        return pa.table([group.column("home"), group.column("slice"), *[pa.array(c, pa.binary()) for c in cells]],
                        ["home", "slice", "target", "n"])

    return by_group(asked, ["home"], ["slice"], answer, "home bigint, slice bigint, target binary, n binary")


def _homes(own: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by home and hash of distinct hashes, and the homes in that order."""
    home = (mixed(own, 33) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return order, home[order]


def _totals(answers: pa.Table, things: np.ndarray, counts: tuple[np.ndarray, np.ndarray], homes: int) -> tuple[np.ndarray, ...]:
    """Target and all totals of a slice's things: its own counts and the answers of all homes."""
    answers = answers.combine_chunks()
    by, out = np.argsort(answers.column("home").to_numpy()), []
    for c, own in zip(("target", "n"), counts):
        out.append(own.copy())
        if len(by):
            out[-1][_homes(things, homes)[0]] += np.concatenate([_read(answers, int(k), c, np.int64) for k in by])
    return tuple(out)


def _known(group: pa.Table, homes: int, least: int) -> tuple[pa.Table, Slice, tuple[np.ndarray, ...]]:
    """A slice whose rare words have become the unknown word, and the totals of its words."""
    told = pc.is_valid(group.column("home"))
    row = group.filter(pc.invert(told)).combine_chunks()
    own = Slice.read(row, 0)
    totals = _totals(group.filter(told), own.words, own.counts(own.at, len(own.words)), homes)
    own.words = np.where(totals[1] >= least, own.words, np.uint64(UNKNOWN))
    return row, own, totals


def _asked_pairs(group: pa.Table, homes: int, least: int) -> pa.Table:
    row, own, _ = _known(group, homes, least)
    pairs, pair = own.pairs()
    return pa.table(_questions(row.column("slice")[0].as_py(), pairs, own.counts(pair, len(pairs)), homes), ASKED_NAMES)


def _gathered(group: pa.Table, pairs_told: pa.Table, homes: int, least: int, model: Sums) -> pa.Table:
    """The texts of a slice with the means of their tokens' losses."""
    row, own, totals = _known(group, homes, least)
    pairs, pair = own.pairs()
    tokens = np.diff(own.bounds)
    doc = np.repeat(np.arange(len(tokens)), tokens)
    columns = []
    for k, joint in enumerate(_totals(pairs_told, pairs, own.counts(pair, len(pairs)), homes)):
        count = np.where(own.words == UNKNOWN, model.unknown[k], totals[k]).astype(float)
        w = count[own.at]
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[own.bounds[:-1][tokens > 0]] = model.texts[k]
        p = (w + ALPHA) / (model.tokens[k] + ALPHA * model.size)
        total = np.bincount(doc, -np.log((joint[pair] + MU * p) / (h + MU)), len(tokens))
        columns.append(pa.array(total / np.maximum(tokens, 1), mask=tokens == 0))
    return pa.table([row.column("keys").chunk(0).flatten(), pa.array(tokens), *columns],
                    ["doc_id", "n_tokens", "target_loss", "background_loss"])
