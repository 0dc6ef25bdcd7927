"""Words and shingles of Arrow text batches as 64-bit hashes, without a Python object per word.

A word is a maximal run of characters other than the six ASCII white-space
characters, in lower case. Equal words have equal hashes; the hash of a word is
a polynomial over random byte values, mixed, so different words collide with a
chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# texts are hashed in slices of about this many bytes, which bounds the arrays
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[_SPACE] = 0
_NOT_PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_PLAIN_BYTES = np.where(_NOT_PLAIN, np.uint64(0), _BYTES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run)
    return _powers[0][:n], _powers[1]


@dataclass
class Words:
    """hashes, first and last byte of every word; bounds: the words of text i are bounds[i]:bounds[i+1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    text_bounds: np.ndarray


def slices(batch: pa.RecordBatch | pa.Table, column: str | int = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece has about ``size`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(sizes) - sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def words(texts: pa.Array, lower: bool = True, plain: bool = False) -> Words:
    """Null texts count as empty.

    With ``plain`` every ASCII character but letters and digits separates words,
    and only ASCII letters are lowered, so that byte positions are those of the text.
    """
    separates = _NOT_PLAIN if plain else _SPACE
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower and not plain:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if n and data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(empty.astype(np.uint64), empty, empty, np.zeros(n + 1, np.int64), data, offsets)
    inside = ~separates[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes)
    power, inverse = _power(len(data))
    hashes = (np.add.reduceat((_PLAIN_BYTES if plain else _BYTES)[data] * power, starts) * inverse[starts] if len(starts)
              else np.zeros(0, np.uint64))
    return Words(mixed(hashes), starts, ends, np.searchsorted(starts, offsets), data, offsets)


def shingles(found: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words and their bounds by text; a shorter text is one shingle, an empty one none."""
    h, bounds = found.hashes, found.bounds
    sizes = np.diff(bounds)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    outs = np.concatenate([[0], np.cumsum(counts)])
    if not len(h):
        return np.zeros(0, np.uint64), outs
    spread = [mixed(h, 11 + k) for k in range(width)]
    full = np.zeros(len(h), np.uint64)
    for k in range(min(width, len(h))):
        full[:len(h) - k] += spread[k][k:] * np.uint64(2 * k + 1)
    at = np.repeat(bounds[:-1] - outs[:-1], counts) + np.arange(outs[-1])
    result = full[at]
    for i in np.flatnonzero((sizes > 0) & (sizes < width)):
        part = sum(int(spread[k][bounds[i] + k]) * (2 * k + 1) for k in range(sizes[i]))
        result[outs[i]] = np.uint64((part + 0x5851F42D4C957F2D * int(sizes[i])) & 0xFFFFFFFFFFFFFFFF)
    return mixed(result, 3), outs


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every run ``bounds[i]:bounds[i+1]``, and their bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    joined = np.concatenate(parts) if parts else values[:0]
    return joined, np.concatenate([[0], np.cumsum(sizes)])
