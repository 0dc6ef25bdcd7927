"""Quality of documents by attention over their passages (multiple-instance learning).

A document is a bag of passages and only its label is known. Every passage is
encoded, h = tanh(x W + b); gated attention weighs it,
a = softmax(w . (tanh(V h) * sigmoid(U h))); and the weighted passage
z = sum(a h) is scored, sigmoid(c . z + d). One bad passage in a long document
can so decide the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import fresh
from llm.words import distinct, shingles, slices, words

PASSAGE = 64          # words
SAMPLE_DOCS = 4_000   # most labelled documents the model is fitted on, drawn by a hash of the key
SAMPLE_PASSAGES = 64  # most passages of one of them, spread evenly
HIDDEN, GATES = 16, 8
EPOCHS = 300
SLICE = 1 << 20        # bytes of text whose features are made together, which bounds the arrays of a task
REJECT_BELOW = 0.3

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()", b"#$%&*@^~", b"|<>{}[]\\/_=+`", b"!?"]
_OF_BYTE = np.full(256, len(_CLASSES) + 1, np.uint8)  # the last class: bytes of other characters
for _k, _chars in enumerate(_CLASSES):
    _OF_BYTE[list(_chars)] = _k
_OF_BYTE[[32, 9, 10, 11, 12, 13]] = len(_CLASSES)
FEATURES = len(_CLASSES) + 2 + 6


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of every text and the bounds of texts; an empty text has one passage of zeros.

    Shares of character classes, mean word length, share of words that repeat
    the word before, share that repeat a word of the passage, share of the
    passage's five-word shingles that stand elsewhere in the document, share of
    one-character words, and the passage's length.
    """
    found = words(texts, lower=False)
    sizes = np.diff(found.bounds)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((bounds[-1], FEATURES))
    full = np.flatnonzero(np.repeat(sizes > 0, counts))
    if not len(full):
        return out, bounds
    nth = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
    doc = np.repeat(np.arange(len(sizes)), counts)
    first = (found.bounds[doc] + nth * PASSAGE)[full]
    last = np.minimum(found.bounds[doc + 1][full], first + PASSAGE)
    n = (last - first).astype(float)
    low, high = found.starts[first], found.ends[last - 1] + 1
    kinds = _OF_BYTE[found.data]
    for k in range(len(_CLASSES) + 2):
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        out[full, k] = (total[high] - total[low]) / (high - low)
    h, at = found.hashes, np.repeat(np.arange(len(first)), last - first)
    lengths = found.ends - found.starts + 1
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first] = False
    own, own_bounds = distinct(h, np.append(first, len(h)))
    runs, run_bounds = shingles(found)
    again = _repeated(runs, run_bounds)
    word_of = np.repeat(found.bounds[:-1] - run_bounds[:-1], np.diff(run_bounds)) + np.arange(len(runs))
    m = len(_CLASSES) + 2
    out[full, m] = np.bincount(at, lengths, len(first)) / n / 10
    out[full, m + 1] = np.bincount(at, same, len(first)) / n
    out[full, m + 2] = 1 - np.diff(own_bounds) / n
    out[full, m + 3] = np.bincount(at[word_of], again, len(first)) / n
    out[full, m + 4] = np.bincount(at, lengths == 1, len(first)) / n
    out[full, m + 5] = np.log1p(n) / np.log1p(PASSAGE)
    return out, bounds


def _repeated(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which values occur more than once within their run."""
    out = np.zeros(len(values), bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > 1:
            order = np.argsort(values[a:b], kind="stable")
            near = values[a:b][order]
            pair = near[1:] == near[:-1]
            twice = np.zeros(b - a, bool)
            twice[1:] |= pair
            twice[:-1] |= pair
            out[a + order] = twice
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.mean) / self.scale, bounds)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    s = (t * g) @ w["w"]
    e = np.exp(s - np.maximum.reduceat(s, bounds[:-1])[bag])
    a = e / np.add.reduceat(e, bounds[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, bounds[:-1])
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the log loss, both classes weighing the same; deterministic."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - mean) / scale
    w = {"W": rng.normal(0, 0.3, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATES)),
         "U": rng.normal(0, 0.3, (HIDDEN, GATES)), "w": rng.normal(0, 0.3, GATES), "c": rng.normal(0, 0.3, HIDDEN),
         "d": np.zeros(1)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, epochs + 1):
        f = _forward(w, x, bounds)
        bag, h, t, g, a = (f[k] for k in ("bag", "h", "t", "g", "a"))
        dp = (f["p"] - y) * share
        dz = dp[:, None] * w["c"]
        da = (dz[bag] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, bounds[:-1])[bag])
        dt, dg = ds[:, None] * w["w"] * g * (1 - t * t), ds[:, None] * w["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        grads = {"c": f["z"].T @ dp, "d": np.array([dp.sum()]), "w": (t * g).T @ ds, "V": h.T @ dt, "U": h.T @ dg,
                 "W": x.T @ dh, "b": dh.sum(0)}
        for k, v in w.items():
            m, s = moments[k]
            grad = grads[k] + decay * v
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            v -= 0.03 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(key: Column) -> Column:
    """Rows that no model may learn from; a null key is never labelled."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE_DOCS) -> Model | None:
    """A model of at most ``sample`` labelled documents outside the held-out fifth; None if a class is missing.

    The sample is drawn by a hash of the key, so it is the same on every run.
    Null labels are ignored; of several labels of a key the largest counts.
    """
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
             .groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label")).orderBy(F.md5(F.col("_key").cast("string"))).limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                x, bounds = passages(part.column("text"))
                bags = [x[a:b] if b - a <= SAMPLE_PASSAGES else x[np.linspace(a, b - 1, SAMPLE_PASSAGES).astype(int)]
                        for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"),
                                                  pa.array([b.ravel() for b in bags], pa.list_(pa.float64()))],
                                                 ["key", "label", "bag"])

    chosen = docs.join(F.broadcast(known), docs[key] == known["_key"])
    kind = docs.schema[key].dataType.simpleString()
    rows = (chosen.select(docs[key].alias("key"), known["_label"].cast("int").alias("label"), docs[text].alias("text"))
            .mapInArrow(run, f"key {kind}, label int, bag array<double>").orderBy("key", "label", F.md5(F.col("bag").cast("string")))
            .limit(2 * sample).toPandas())
    if rows["label"].nunique() < 2:
        return None
    bags = [np.asarray(b).reshape(-1, FEATURES) for b in rows["bag"]]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return fit(np.concatenate(bags), bounds, (rows["label"].to_numpy() == 1).astype(float))


def _scored(rows: DataFrame, model: Model | None, text: int, drop: bool, name: str = "score") -> DataFrame:
    """``rows`` with a score of the column at ``text``, which crosses to the tasks once and comes back unless it is dropped."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = [k for k in range(len(rows.columns)) if not drop or k != text]
    names = [*[rows.columns[k] for k in kept], name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                x, bounds = passages(part.column(text))
                scores = model.score(x, bounds) if model and part.num_rows else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(scores, pa.float64())], names)

    return rows.mapInArrow(run, StructType([*[rows.schema.fields[k] for k in kept], StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """(key, ``keep`` columns, score) for every row, each on its own; the score uses the text only.

    A null text counts as empty and is scored too; without a model every score
    is 0.5. Null and repeated keys keep their rows; other columns are left out.
    """
    rows = docs.select(docs[key].alias(key), *[docs[c] for c in keep], docs[text].alias("_text"))
    return _scored(rows, model, len(rows.columns) - 1, True)


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = REJECT_BELOW,
             **settings) -> DataFrame:
    """``docs`` without the documents scored below ``least``; all columns and repeated rows stay."""
    model = train(docs, labels, key, text, **settings)
    told = fresh("_score", docs.columns)
    return _scored(docs, model, docs.columns.index(text), False, told).where(F.col(told) >= least).select(*docs.columns)
