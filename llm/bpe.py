"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that the merges
produce. It starts with one state and an arc for every byte. The gadget of a
merge (a, b) adds an arc ab wherever a and then b could be read, leading where
b leads, and takes arc b from the state behind a. Every token leads to one
state, so the whole automaton is described by when an arc came and went:

* an arc y = (a, b) came, at y's merge, to every state that then still had a;
* the state behind x = (a, b) was, at x's merge, the state behind b;
* the merge (x, y) took arc y from the state behind x.

Byte strings are read by a second table, built from the first as words need it:
its states are prefixes, and each knows the last token of its only accepted
reading and the state before that token. Encoding a word is one table step per
byte and a walk back over the tokens; decoding emits the label of every arc.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from llm.words import slices

# the pre-split of byte-level vocabularies (a fixed value of the format)
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# tables that grow with the words seen are emptied beyond these sizes, or fewer that a caller asks for; this changes no result
STATES = 400_000
WORDS = 400_000


def _alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files: itself if printable, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """Compiled from a tokenizers file of byte-level BPE without normalizer, prefix space or dropout."""

    def __init__(self, path: str, held: int = WORDS):
        self.held = held
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        byte_of, vocab = _alphabet(), found["model"]["vocab"]
        self.ids = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        self.labels = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in found.get("added_tokens", []))]))
        for token, i in self.ids.items():
            self.labels[i] = token
        self.special = {t["content"]: t["id"] for t in found.get("added_tokens", [])}
        for token, i in self.special.items():
            self.labels[i] = token.encode()
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.rank: dict[tuple[int, int], int] = {}
        self.made, self.left, self.right = ([0] * len(self.labels) for _ in range(3))
        for k, merge in enumerate(found["model"]["merges"], 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(vocab[a], vocab[b], vocab[a + b], k)
        self._arcs()
        self._clear()

    def _gadget(self, a: int, b: int, ab: int, time: int) -> None:
        self.rank[a, b] = time
        self.made[ab], self.left[ab], self.right[ab] = time, a, b

    def _arcs(self) -> None:
        """Labels as a tree of bytes: which tokens end at a byte is read off a node, with one step per byte."""
        self.down: dict[int, int] = {}
        self.fall, self.ends, depth = [0], [()], [[]]
        ends = {}
        for label, token in self.ids.items():
            node = 0
            for k, byte in enumerate(label):
                key = node << 8 | byte
                node = self.down.get(key, 0)
                if not node:
                    node = self.down[key] = len(self.fall)
                    self.fall.append(0)
                    self.ends.append(())
                    if len(depth) <= k + 1:
                        depth.append([])
                    depth[k + 1].append((node, key))
            ends[node] = token
        for level in depth[1:]:
            for node, key in level:
                if key >> 8:
                    self.fall[node] = self._read(self.fall[key >> 8], key & 255)
                own = ((ends[node], len(self.labels[ends[node]])),) if node in ends else ()
                self.ends[node] = own + self.ends[self.fall[node]]

    def _read(self, node: int, byte: int) -> int:
        """The node of the longest end of what was read that begins a label."""
        while True:
            below = self.down.get(node << 8 | byte)
            if below is not None or not node:
                return below or 0
            node = self.fall[node]

    def allowed(self, x: int, y: int) -> bool:
        """Whether the state behind token x has an arc y after all gadgets."""
        until = len(self.rank) + 1
        while True:
            if self.rank.get((x, y), until) < until:
                return False
            if self.made[x] > self.made[y]:
                until, x = self.made[x], self.right[x]
            elif self.made[y]:
                until, y = self.made[y] + 1, self.left[y]
            else:
                return True

    def _clear(self) -> None:
        self.step: dict[int, int] = {}
        self.last, self.before, self.node = [-1], [0], [0]
        self.known: dict[int, bool] = {}

    def _follows(self, x: int, y: int) -> bool:
        found = self.known[x << 24 | y] = self.allowed(x, y)
        return found

    def word(self, word: bytes) -> list[int]:
        if max(len(self.last), len(self.known)) > min(STATES, self.held):
            self._clear()
        state, path, step, last, known = 0, [0], self.step, self.last, self.known
        for k, byte in enumerate(word):
            key = state << 8 | byte
            state = step.get(key)
            if state is None:
                node = self._read(self.node[key >> 8], byte)
                for token, size in self.ends[node]:
                    before = path[k + 1 - size]
                    if not before or (known.get(last[before] << 24 | token) if last[before] << 24 | token in known
                                      else self._follows(last[before], token)):
                        break
                else:
                    raise ValueError("no token ends here: the vocabulary lacks a byte")
                state = step[key] = len(last)
                last.append(token)
                self.before.append(before)
                self.node.append(node)
            path.append(state)
        tokens = []
        while state:
            tokens.append(last[state])
            state = self.before[state]
        return tokens[::-1]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """Ids of pre-split words as little-endian 32-bit integers, filled as words come."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        made = packed(self.automaton.word(word.encode()))
        if len(word) < 40:
            self[word] = made
        return made


class Chunks(dict):
    """The same for what stands between two spaces, with the space before it.

    The pre-split never joins what is on either side of a space that a character
    other than white space follows, so such a chunk can be split on its own;
    for any other chunk this raises KeyError.
    """

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[0] in "\x85\xa0":
            raise KeyError(chunk)
        made = b"".join(map(self.pieces.__getitem__, PATTERN.findall(" " + chunk)))
        if len(chunk) < 24:
            self[chunk] = made
        return made


class Encoder:
    """Encodes and decodes texts with one automaton and what it has seen so far."""

    def __init__(self, path: str, held: int = WORDS):
        self.held = held
        self.automaton = Automaton(path, held)
        self.pieces = Pieces(self.automaton)
        self.chunks = Chunks(self.pieces)

    def encode(self, text: str) -> bytes:
        cut, at, parts = self.automaton.cut, 0, []
        for match in cut.finditer(text) if cut and any(map(text.__contains__, self.automaton.special)) else ():
            parts.append(self._plain(text[at:match.start()]))
            parts.append(packed([self.automaton.special[match[0]]]))
            at = match.end()
        parts.append(self._plain(text[at:] if at else text))
        for seen in (self.pieces, self.chunks):
            if len(seen) > min(WORDS, self.held):
                seen.clear()
        return b"".join(parts)

    def _plain(self, text: str) -> bytes:
        chunks = text.split(" ")
        try:
            rest = b"".join(map(self.chunks.__getitem__, chunks[1:]))
        except KeyError:
            return b"".join(map(self.pieces.__getitem__, PATTERN.findall(text)))
        return b"".join(map(self.pieces.__getitem__, PATTERN.findall(chunks[0]))) + rest

    def decode(self, ids: bytes) -> str:
        labels = self.automaton.labels
        return b"".join(map(labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, held: int = WORDS) -> Encoder:
    """One per worker process; compiling takes about a second."""
    if (path, held) not in _encoders:
        _encoders[path, held] = Encoder(path, held)
    return _encoders[path, held]


def encode(docs: DataFrame, path: str, decoded: bool = False, key: str = "doc_id", text: str = "text", held: int = WORDS) -> DataFrame:
    """(key, ids binary) for every row, and with ``decoded`` the decoded text beside it.

    ids holds little-endian unsigned 32-bit integers. Strings of special tokens
    in a text become those tokens. A null or empty text has no ids and decodes
    to the empty text; null and repeated keys keep their rows; other columns
    are left out whatever their names. ``path`` must name the file on every
    executor. Texts are never cut; no row meets another, so nothing is shuffled.
    A task keeps what it knows of about ``held`` words: fewer cost time, and no result.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, held)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [made.encode(t) if t else b"" for t in part.column("text").to_pylist()]
                columns = [part.column("key"), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([made.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][:len(columns)])

    return (docs.select(docs[key].alias("key"), docs[text].alias("text"))
            .mapInArrow(run, f"`{key}` {kind}, ids binary" + ", decoded string" * decoded))


def decode(frame: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) from the binary ids that ``encode`` gives; null ids decode to the empty text."""
    kind = frame.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        for batch in batches:
            texts = [made.decode(i or b"") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], [key, "decoded"])

    return frame.select(frame[key].alias("key"), frame[ids].alias("ids")).mapInArrow(run, f"`{key}` {kind}, decoded string")
