"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts become words: maximal runs of ASCII letters and digits and of characters
beyond ASCII, with A-Z lowered. A window is ``window`` consecutive words of an
item; an item of fewer words, but not none, is one window. The automaton of all
items has a state for every set of equal occurrences of word runs. Training
words are streamed through it: the state and the length of the longest run that
ends here and stands in an item are kept at every word. Where that length
reaches a window's, the window's state is the current state or one above it by
suffix links, and names the items. Words in any occurrence of a window are hit.

Items are gathered into blocks of about ``BLOCK`` words, an automaton each, so
what is sent to the executors is bounded however many items there are; long
items are cut into pieces that overlap by a window. Texts pass the blocks one
after another, each pass adding to what a row carries. Words are known by
64-bit hashes.

Only stretches of words whose neighbours are neighbours in an item too are
streamed, and only those as long as the shortest window: no other words can be
hit.

Rows: every document gives one row, repeated rows and repeated keys too. Null
and empty texts have no words and no hits. Null, empty and wordless items have
no window; an empty table of items hits nothing. A repeated item id counts
once, whatever its texts; a null id counts as an item. Extra columns of any
name are allowed. Text keys are allowed.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import by_group, fresh, saved, shipped
from llm.words import slices, words

WINDOW = 10
MAX_SHARE = 0.5       # a document with a larger share of hit words goes
BLOCK = 200_000       # words of items in an automaton
PIECE = 20_000        # words of a piece of a long item
CHAIN = 4             # automata that texts pass before they are written


class Automaton:
    """States, arcs and suffix links of the word runs of sequences, added one after another."""

    def __init__(self) -> None:
        self.arcs: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        at = 0
        for word in sequence:
            at = self._extend(at, word)

    def _extend(self, last: int, word: int) -> int:
        arcs, link, length = self.arcs, self.link, self.length
        known = arcs[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, known, word)
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        above = last
        while above >= 0 and word not in arcs[above]:
            arcs[above][word] = new
            above = link[above]
        if above >= 0:
            other = arcs[above][word]
            link[new] = other if length[other] == length[above] + 1 else self._split(above, other, word)
        return new

    def _split(self, at: int, state: int, word: int) -> int:
        """Parts the runs of ``state`` that are as short as those of ``at`` with ``word`` from the longer ones."""
        arcs, link = self.arcs, self.link
        copy = len(arcs)
        arcs.append(dict(arcs[state]))
        self.length.append(self.length[at] + 1)
        link.append(link[state])
        link[state] = copy
        while at >= 0 and arcs[at].get(word) == state:
            arcs[at][word] = copy
            at = link[at]
        return copy

    def ends(self, sequence: list[int], width: int) -> Iterator[int]:
        """The state of every run of ``width`` words of an added sequence."""
        link, length = self.link, self.length
        at = 0
        for i, word in enumerate(sequence):
            at = self.arcs[at][word]
            while length[link[at]] >= min(i + 1, width):
                at = link[at]
            if i + 1 >= width:
                yield at


def _compiled(items: list, sequences: list[np.ndarray], window: int) -> bytes:
    """The automaton of the sequences as arrays; items[i] is the key of sequences[i]."""
    vocabulary, ids = np.unique(np.concatenate(sequences), return_inverse=True)
    cuts = np.cumsum([0, *map(len, sequences)])
    runs = [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    machine = Automaton()
    for run in runs:
        machine.add(run)
    keys = {k: i for i, k in enumerate(dict.fromkeys(items))}
    held: dict[tuple[int, int], set[int]] = defaultdict(set)
    for item, run in zip(items, runs):
        width = min(window, len(run))
        for state in machine.ends(run, width):
            held[state, width].add(keys[item])
    outputs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for (state, width), found in held.items():
        outputs[state].append((width, sorted(found)))
    size = len(vocabulary)
    starts, words_, ends = (np.array(x, np.int64) for x in zip(
        *((s, w, t) for s, arcs in enumerate(machine.arcs) for w, t in arcs.items())))
    first = machine.arcs[0]
    pairs = np.sort(np.array([w * size + x for w, s in first.items() for x in machine.arcs[s]], np.int64))
    return pickle.dumps({"keys": list(keys), "vocabulary": vocabulary, "pairs": pairs, "arcs": starts * size + words_, "ends": ends,
                         "link": np.array(machine.link), "length": np.array(machine.length), "outputs": dict(outputs),
                         "least": min(width for _, width in held)})


class Scanner:
    """Streams texts through one compiled automaton."""

    def __init__(self, packed: bytes):
        made = pickle.loads(packed)
        self.keys, self.vocabulary, self.pairs, self.least = made["keys"], made["vocabulary"], made["pairs"], made["least"]
        self.arcs = dict(zip(made["arcs"].tolist(), made["ends"].tolist()))
        self.link, self.length, self.outputs = made["link"].tolist(), made["length"].tolist(), made["outputs"]
        # the nearest state at or above each one, by suffix links, that ends a window
        self.near = [-1] * len(self.link)
        for state in np.argsort(made["length"], kind="stable").tolist():
            self.near[state] = state if state in self.outputs else self.near[self.link[state]] if state else -1

    def stretches(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Word numbers, and the stretches of words to stream."""
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == hashes
        joined = known[1:] & known[:-1]
        inner = bounds[(bounds > 0) & (bounds < len(hashes))]
        joined[inner - 1] = False
        at = np.flatnonzero(joined)
        if len(self.pairs):
            codes = ids[at] * len(self.vocabulary) + ids[at + 1]
            joined[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)] == codes
        else:
            joined[at] = False
        begins = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        ends = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        long = ends - begins >= self.least
        return ids, list(zip(begins[long].tolist(), ends[long].tolist()))

    def stream(self, ids: list[int], base: int, marks: np.ndarray, found: set[int]) -> int:
        """Marks the hit words of a stretch that starts at ``base`` and adds the items; returns the longest match."""
        arcs, link, length, near, outputs, size = self.arcs, self.link, self.length, self.near, self.outputs, len(self.vocabulary)
        state = matched = longest = 0
        for i, word in enumerate(ids):
            step = arcs.get(state * size + word)
            while step is None:
                state = link[state]
                matched = length[state]
                step = arcs.get(state * size + word)
            state, matched = step, matched + 1
            longest = max(longest, matched)
            at = near[state]
            while at >= 0:
                for width, items in outputs[at]:
                    if width <= matched:
                        marks[base + i + 1 - width:base + i + 1] = True
                        found.update(items)
                at = near[link[at]] if at else -1
        return longest


def _automata(items: DataFrame, key: str, text: str, window: int) -> tuple[DataFrame, int]:
    """(block, made): a compiled automaton for every block of items."""
    kind = items.select(items[key]).schema[0].dataType
    named = items.select(items[key].alias("item"), items[text].cast("string").alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                split = words(part.column("text"), plain=True)
                rows, runs = [], []
                for i, (a, b) in enumerate(zip(split.bounds, split.bounds[1:])):
                    for at in range(a, max(a + 1, b - window + 1), PIECE):
                        if b > a:
                            rows.append(i)
                            runs.append(split.hashes[at:min(b, at + PIECE + window - 1)].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(rows, pa.int64())), pa.array(runs, pa.binary())], ["item", "run"])

    cut = saved(named.mapInArrow(pieces, f"item {kind.simpleString()}, run binary").distinct(), "items")
    total = cut.agg(F.sum(F.octet_length("run") / 8)).first()[0] or 0
    blocks = math.ceil(total / BLOCK)
    if not blocks:
        return cut, 0

    def compiled(rows: pa.Table) -> pa.Table:
        made = _compiled(rows.column("item").to_pylist(), [np.frombuffer(x, np.uint64) for x in rows.column("run").to_pylist()], window)
        return pa.table({"block": rows.column("block").slice(0, 1), "made": pa.array([made], pa.binary())})

    dealt = cut.withColumn("block", F.pmod(F.xxhash64("run"), F.lit(blocks)).cast("int"))
    return saved(by_group(dealt, ["block"], ["run", "item"], compiled, "block int, made binary"), "automata"), blocks


def _scanned(docs: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str, window: int,
             clean: bool) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` and columns of results, and their names by what they hold; with ``clean`` the cut texts too, else no text."""
    shipped(docs.sparkSession)
    automata, blocks = _automata(items, item_key, item_text, window)
    kind = items.select(items[item_key]).schema[0].dataType.simpleString()
    names = {n: fresh(n, docs.columns) for n in ("n_words", "longest", "spans", "items", *["clean"] * clean)}
    types = {"n_words": "bigint", "longest": "bigint", "spans": "array<struct<start: bigint, end: bigint>>", "items": f"array<{kind}>", "clean": "string"}
    empty = {"n_words": "0L", "longest": "0L", "spans": f"cast(array() AS {types['spans']})", "items": f"cast(array() AS {types['items']})", "clean": "''"}
    out = docs.select("*", *[F.expr(empty[n]).cast(types[n]).alias(names[n]) for n in names])
    context = docs.sparkSession.sparkContext
    for block in range(max(1, blocks)):
        row = automata.where(F.col("block") == block).select("made").first() if blocks else None
        packed = context.broadcast(row.made) if row else None
        last = block >= blocks - 1
        schema = out.drop(text).schema if last and not clean else out.schema
        out = out.mapInArrow(_pass(packed, text, names, schema.names), schema)
        if block % CHAIN == CHAIN - 1 and block < blocks - 1:
            out = saved(out, "scanned")
    return out, names


def _pass(packed, text: str, names: dict[str, str], wanted: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(packed.value) if packed is not None else None
        for batch in batches:
            for part in slices(batch, text):
                yield _batch(scanner, part, text, names).select(wanted)
    return run


def _batch(scanner: Scanner | None, part: pa.RecordBatch, text: str, names: dict[str, str]) -> pa.RecordBatch:
    split = words(part.column(text), plain=True)
    sizes = np.diff(split.bounds)
    marks = np.zeros(len(split.hashes), bool)
    columns = {n: part.column(part.schema.get_field_index(names[n])) for n in names}
    longest = np.asarray(columns["longest"]).copy()
    lists, spans = columns["items"].to_pylist(), columns["spans"].to_pylist()
    for i, kept in enumerate(spans):
        for s in kept:
            marks[split.bounds[i] + s["start"]:split.bounds[i] + s["end"]] = True
    if scanner is not None and len(split.hashes):
        ids, stretches = scanner.stretches(split.hashes, split.bounds)
        found: dict[int, set[int]] = defaultdict(set)
        owners = np.searchsorted(split.bounds, [a for a, _ in stretches], "right") - 1
        for (a, b), i in zip(stretches, owners.tolist()):
            longest[i] = max(longest[i], scanner.stream(ids[a:b].tolist(), a, marks, found[i]))
        for i, items in found.items():
            lists[i] = list(dict.fromkeys([*lists[i], *(scanner.keys[x] for x in sorted(items))]))
    kinds = {n: part.schema.field(names[n]).type for n in names}
    made = {"n_words": pa.array(sizes, pa.int64()), "longest": pa.array(longest, pa.int64()), "items": pa.array(lists, kinds["items"]),
            "spans": _spans(marks, split.bounds, kinds["spans"])}
    if "clean" in names:
        made["clean"] = _cleaned(part.column(text), split, marks)
    results = {names[n]: a.cast(kinds[n]) for n, a in made.items()}
    return pa.RecordBatch.from_arrays([results.get(f.name, part.column(j)) for j, f in enumerate(part.schema)], schema=part.schema)


def _runs(marks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last of every run of marked words within a text."""
    edge = np.zeros(len(marks) + 1, bool)
    edge[bounds] = True
    begins = np.flatnonzero(marks & (edge[:-1] | ~np.concatenate([[False], marks[:-1]])))
    ends = np.flatnonzero(marks & (edge[1:] | ~np.concatenate([marks[1:], [False]]))) + 1
    return begins, ends


def _spans(marks: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    begins, ends = _runs(marks, bounds)
    cuts = np.searchsorted(begins, bounds)
    base = np.repeat(bounds[:-1], np.diff(cuts))
    pairs = pa.StructArray.from_arrays([pa.array(begins - base), pa.array(ends - base)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs).cast(kind)


def _cleaned(texts: pa.Array, split, marks: np.ndarray) -> pa.Array:
    """Texts without the bytes from the first to the last word of every marked run."""
    begins, ends = _runs(marks, split.bounds)
    change = np.zeros(len(split.data) + 1, np.int64)
    np.add.at(change, split.starts[begins], 1)
    np.add.at(change, split.ends[ends - 1] + 1, -1)
    kept = np.cumsum(change[:-1]) == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[split.text_bounds].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(split.data[kept])).cast(pa.string())


def scan(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_hit, longest, spans (word positions, end exclusive), items (keys, each once), a row per document.

    longest is the longest run of words that stands in an item, of the streamed stretches; 0 if there are none.
    """
    named = docs.select(docs[key].alias(key), docs[text].cast("string").alias("_text" if key != "_text" else "__text"))
    out, names = _scanned(named, items, named.columns[1], item_key, item_text, window, False)
    hit = F.aggregate(F.col(names["spans"]), F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col(key), F.col(names["n_words"]).alias("n_words"), hit.alias("n_hit"), F.col(names["longest"]).alias("longest"),
                      F.col(names["spans"]).alias("spans"), F.col(names["items"]).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` without the hit spans of their texts, and without documents whose hit words exceed ``max_share`` of all.

    A span goes from its first to its last word; white space and marks around
    it stay. A text without hits is unchanged, a null one stays null.
    """
    out, names = _scanned(docs, items, text, item_key, item_text, window, True)
    hit = F.aggregate(F.col(names["spans"]), F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    kept = out.where(hit <= F.col(names["n_words"]) * F.lit(max_share))
    clean = F.when(F.size(names["spans"]) > 0, F.col(names["clean"])).otherwise(F.col(text))
    return kept.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
