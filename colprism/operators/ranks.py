"""Exact quantiles and order statistics without sorting or shuffling the rows.

Spark's exact ``percentile`` holds every distinct value of a column in one
aggregation buffer. That is right for small tables and impossible for large
ones, so above a size the value at a rank is found by narrowing an interval
around it: one aggregate counts the values in equal parts of the interval,
the running counts say which part holds the rank, and that part, shrunk to
its own smallest and largest value, is the next interval. A part whose ends
are equal is the answer however often the value repeats. Where equal parts do
not help (values of very different magnitude), a mergeable sketch picks the
cuts instead.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprism.operators.facts import lookup, tall

# most cells (rows x columns) whose distinct values may sit in aggregation buffers
BUFFERED_CELLS = 1_000_000
# most values of one interval that are gathered to pick a rank from
GATHERED = 5_000
# most (interval, part) rows one counting round may return
PART_ROWS = 100_000
GRID = [i / 200 for i in range(201)]


class _Interval:
    """A closed interval of one column, with the ranks still wanted inside it."""

    def __init__(self, at, low, high, below, inside, ranks, stuck=False):
        self.at, self.low, self.high = at, low, high
        self.below, self.inside, self.ranks, self.stuck = below, inside, ranks, stuck


def order_values(df: DataFrame, exprs: dict[str, Column], ranks: dict[str, list[int]],
                 ranges: dict[str, tuple[int, float, float]] | None = None,
                 gathered: int = GATHERED) -> dict[tuple[str, int], float]:
    """The values at the given 0-based ranks of each finite double expression.

    ``ranges`` holds (non-null count, min, max) per expression when known.
    """
    keys = list(exprs)
    cells = tall(df, exprs)
    ranges = ranges or value_ranges(df, exprs)
    found: dict[tuple[int, int], float] = {}
    todo = [_Interval(i, ranges[k][1], ranges[k][2], 0, ranges[k][0], sorted(set(ranks[k])))
            for i, k in enumerate(keys) if ranges[k][0] and ranks.get(k)]
    while todo:
        for t in [t for t in todo if t.low == t.high]:
            found.update({(t.at, r): t.low for r in t.ranks})
        todo = [t for t in todo if t.low < t.high]
        small = [t for t in todo if t.inside <= gathered]
        if small:
            _gather(cells, small, len(keys), found)
        large = [t for t in todo if t.inside > gathered]
        todo = _narrow(cells, large, len(keys)) if large else []
    return {(keys[at], rank): value for (at, rank), value in found.items()}


def value_ranges(df: DataFrame, exprs: dict[str, Column]) -> dict[str, tuple[int, float, float]]:
    """(non-null count, min, max) per expression."""
    keys = list(exprs)
    rows = tall(df, exprs).groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    return {k: (0, None, None) for k in keys} | {keys[r["at"]]: (r["n"], r["low"], r["high"]) for r in rows}


def _located(cells: DataFrame, intervals: list[_Interval], width: int) -> DataFrame:
    """Keeps the values inside some interval and says which: (interval, x)."""
    per_key: list[list[int]] = [[] for _ in range(width)]
    for number, t in enumerate(intervals):
        per_key[t.at].append(number)
    x, picks = F.col("x"), []
    for slot in range(max(len(p) for p in per_key)):
        chosen = [p[slot] if slot < len(p) else None for p in per_key]
        low = lookup([intervals[n].low if n is not None else math.inf for n in chosen])
        high = lookup([intervals[n].high if n is not None else -math.inf for n in chosen])
        number = lookup([n if n is not None else -1 for n in chosen])
        picks.append(F.when((x >= low) & (x <= high), number))
    return cells.select(F.coalesce(*picks, F.lit(-1)).alias("interval"), "x").where("interval >= 0")


def _gather(cells, intervals, width, found):
    ordered = F.sort_array(F.collect_list("x"))
    offsets = F.get(F.array(*[F.array(*[F.lit(r - t.below) for r in t.ranks]) for t in intervals]), F.col("interval"))
    picked = (_located(cells, intervals, width).groupBy("interval").agg(ordered.alias("v"))
              .select("interval", F.transform(offsets, lambda o: F.get(F.col("v"), o.cast("int"))).alias("v")))
    for row in picked.collect():
        t = intervals[row["interval"]]
        for rank, value in zip(t.ranks, row["v"]):
            found[(t.at, rank)] = value


def _narrow(cells, intervals, width):
    fullest = max(t.inside for t in intervals)
    parts = max(64, min(4096, PART_ROWS // len(intervals), 4 * fullest // GATHERED))
    x, low, span = F.col("x"), F.col("low"), F.col("span")
    by = {"at": "interval"}
    placed = (_located(cells, intervals, width)
              .select("interval", "x", lookup([t.low for t in intervals], **by).alias("low"),
                      # halves, so that the span of the whole double range stays finite
                      lookup([t.high / 2 - t.low / 2 for t in intervals], **by).alias("span")))
    part = F.least(F.floor((x / 2 - low / 2) / span * parts).cast("int"), F.lit(parts - 1))
    if any(t.stuck for t in intervals):
        cuts = _pivots(cells, intervals, width)
        u, v = (lookup([c[side] for c in cuts], **by) for side in (0, 1))
        segment = F.when(x < u, 0).when(x == u, 1).when(x < v, 2).when(x == v, 3).otherwise(4)
        part = F.when(lookup([t.stuck for t in intervals], **by), segment).otherwise(part)
    counted = (placed.select("interval", "x", part.alias("part")).groupBy("interval", "part")
               .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    left, running = {}, {}
    for row in sorted(counted.collect(), key=lambda r: (r["interval"], r["part"])):
        t = intervals[row["interval"]]
        below = running.get(row["interval"], t.below)
        running[row["interval"]] = below + row["n"]
        for rank in t.ranks:
            if below <= rank < below + row["n"]:
                key = (row["interval"], row["part"])
                if key not in left:
                    left[key] = _Interval(t.at, row["low"], row["high"], below, row["n"], [],
                                          stuck=row["n"] > t.inside // 2)
                left[key].ranks.append(rank)
    return list(left.values())


def _pivots(cells, intervals, width):
    """Two data values around the first wanted rank of each stuck interval."""
    stuck = [t for t in intervals if t.stuck]
    sketched = (_located(cells, stuck, width).groupBy("interval")
                .agg(F.percentile_approx("x", GRID, 10_000).alias("cuts"))).collect()
    around = {}
    for row in sketched:
        t = stuck[row["interval"]]
        at = bisect_left(GRID, (t.ranks[0] - t.below) / max(t.inside - 1, 1))
        around[id(t)] = (row["cuts"][max(at - 1, 0)], row["cuts"][min(at + 1, len(GRID) - 1)])
    return [around.get(id(t), (0.0, 0.0)) for t in intervals]


def quantiles(df: DataFrame, exprs: dict[str, Column], probabilities: list[float],
              ranges: dict[str, tuple[int, float, float]] | None = None, buffered_cells: int = BUFFERED_CELLS) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several double expressions, exact at any size."""
    keys, nothing = list(exprs), [None] * len(probabilities)
    if not keys:
        return {}
    ranges = ranges or value_ranges(df, exprs)
    counts = {k: ranges[k][0] for k in keys}
    if sum(counts.values()) <= buffered_cells:
        wanted = F.array(*[F.lit(p) for p in probabilities])
        rows = tall(df, exprs).groupBy("at").agg(F.percentile("x", wanted).alias("q")).collect()
        return {k: nothing for k in keys} | {keys[r["at"]]: list(r["q"]) for r in rows}
    ranks = {k: [r for p in probabilities for r in _neighbours(counts[k], p)] if counts[k] else [] for k in keys}
    values = order_values(df, exprs, ranks, ranges)
    return {k: [_between(values, k, counts[k], p) for p in probabilities] if counts[k] else nothing for k in keys}


def _neighbours(n, p):
    low = math.floor((n - 1) * p)
    return [low, min(low + 1, n - 1)]


def _between(values, key, n, p):
    low, high = _neighbours(n, p)
    a, b = values[(key, low)], values[(key, high)]
    return a + (b - a) * ((n - 1) * p - low)
