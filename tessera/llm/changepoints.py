"""Penalised change points of daily series: the cheapest cut into segments, found by a best-first search of a range tree.

The cost of a segment of n days with sum S and sum of squares Q is ``n * floor(1000 * ln(V))`` with the exact integer
V = 1 + floor((n * Q - S * S) / n^2). For each end day the search asks which start makes prefix and last segment cheapest.
Starts lie in a tree of blocks that keeps the least prefix cost of each block. The squared error about the mean grows with
a segment, so the segment from a block's last start bounds all segments of the block from below; with the least prefix cost
that bounds their totals. Blocks open cheapest first until none is cheaper than, or as cheap as, the best start found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

#: Least days of a segment, and what a cut costs.
LEAST_DAYS, PENALTY = 7, 20_000
#: Starts of a block of the tree, and blocks of a block above.
FAN = 8
#: Series that are cut together have at most so many cells, days times series.
CELLS = 1 << 20
#: A total and its number of segments in one integer, so that one comparison orders both. A series has fewer than 2^20 segments.
SHIFT = 20
NEVER = 1 << 62

SEGMENTS = "segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"


def daily_totals(rows: DataFrame, key: str, at: Column, amount: Column) -> DataFrame:
    """(key, day, total): sums of ``amount`` by key and day since 1970. Rows with a null key, time or amount take no part.

    Sums are made before the shuffle, so a key with a third of all rows sends one row a day and task.
    """
    taken = rows.select(F.col(key).alias("key"), F.unix_date(at.cast("date")).cast("long").alias("day"), amount.cast("long").alias("amount"))
    return taken.where("key IS NOT NULL AND day IS NOT NULL AND amount IS NOT NULL").groupBy("key", "day").agg(F.sum("amount").alias("total"))


def segment_costs(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, cost) of segments, elementwise."""
    spread = 1 + (n * squares - total * total) // (n * n)
    return spread, n * np.floor(1000 * np.log(spread.astype(float))).astype(np.int64)


class RangeTree:
    """Least prefix keys of blocks of FAN, FAN^2, ... starts, of many series side by side; columns of all levels stand in one row."""

    def __init__(self, n_series: int, n_starts: int) -> None:
        self.levels: list[tuple[int, int, int]] = []  # (starts of a block, first column, number of blocks)
        width, column = FAN, 0
        while True:
            blocks = -(-n_starts // width)
            self.levels.append((width, column, blocks))
            column += blocks
            if blocks <= FAN:
                break
            width *= FAN
        self.least = np.full((n_series, column), NEVER, np.int64)
        self.width = np.concatenate([np.full(b, w) for w, _, b in self.levels])
        self.first = np.concatenate([np.arange(b) * w for w, _, b in self.levels])
        self.below = np.concatenate([np.arange(b) * FAN + (self.levels[i - 1][1] if i else 0) for i, (_, _, b) in enumerate(self.levels)])
        self.last_below = np.concatenate([np.full(b, self.levels[i - 1][1] + self.levels[i - 1][2] if i else 0) for i, (_, _, b) in enumerate(self.levels)])

    def insert(self, start: int, keys: np.ndarray) -> None:
        for width, column, _ in self.levels:
            at = column + start // width
            self.least[:, at] = np.minimum(self.least[:, at], keys)

    def roots(self) -> np.ndarray:
        _, column, blocks = self.levels[-1]
        return np.arange(column, column + blocks)


def best_cuts(totals: np.ndarray, lengths: np.ndarray, least_days: int = LEAST_DAYS, penalty: int = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, sums, squares) of series (rows, padded with zeros): keys[:, e] holds the best total and number of segments
    of the first e days, starts[:, e] the start of the last of these segments. Ties: fewest segments, then the earliest start.

    ``totals`` holds 64-bit integers, or Python's where products might not fit.
    """
    m, n = totals.shape
    zero = np.zeros((m, 1), totals.dtype)
    sums, squares = (np.concatenate([zero, np.cumsum(x, axis=1, dtype=totals.dtype)], axis=1) for x in (totals, totals * totals))
    keys, starts, cut = np.full((m, n + 1), NEVER, np.int64), np.zeros((m, n + 1), np.int64), penalty << SHIFT
    keys[:, 0] = 0
    tree = RangeTree(m, n + 1)
    fan = np.arange(FAN)
    shortest = np.minimum(lengths, least_days)
    for end in range(1, n + 1):
        if end >= least_days and (end == least_days or end >= 2 * least_days):  # the start that a segment of the least length to this end has
            fresh = end - least_days
            tree.insert(fresh, keys[:, fresh] + (cut if fresh else 0))
        whole = np.flatnonzero((lengths == end) & (end < least_days))  # a shorter series is one segment
        if whole.size:
            _, cost = segment_costs(np.full(whole.size, end), sums[whole, end], squares[whole, end])
            keys[whole, end] = (cost << SHIFT) + 1
        rows = np.flatnonzero((shortest <= end) & ((lengths == end) | (lengths >= end + least_days))) if end >= least_days else whole[:0]
        if not rows.size:
            continue
        latest = end - least_days
        best, start = np.full(rows.size, NEVER, np.int64), np.full(rows.size, NEVER, np.int64)

        def bounds(at: np.ndarray, column: np.ndarray) -> np.ndarray:
            """Lower bounds of keys by which a segment from a start in the block ``column`` ends at ``end``."""
            row, first = rows[at], tree.first[column]
            last = np.minimum(first + tree.width[column] - 1, latest)
            least = tree.least[row, column]
            shown = (first <= latest) & (least < NEVER)
            last, first = np.where(shown, last, 0), np.where(shown, first, 0)
            days, most = end - last, end - first
            total, square = sums[row, end] - sums[row, last], squares[row, end] - squares[row, last]
            spread = 1 + (days * square - total * total) // (days * most)
            cost = days * np.floor(1000 * np.log(spread.astype(float))).astype(np.int64)
            return np.where(shown, least + (cost << SHIFT) + 1, NEVER)

        frontier = np.full((rows.size, tree.least.shape[1]), NEVER, np.int64)
        roots, everyone = tree.roots(), np.arange(rows.size)
        frontier[:, roots] = bounds(np.repeat(everyone, roots.size), np.tile(roots, rows.size)).reshape(-1, roots.size)
        active = everyone
        while active.size:
            column = frontier[active].argmin(1)
            bound = frontier[active, column]
            going = (bound < NEVER) & (bound <= best[active])
            active, column = active[going], column[going]
            frontier[active, column] = NEVER
            leaf = tree.width[column] == FAN
            at, opened = active[~leaf], column[~leaf]
            if at.size:
                below = tree.below[opened][:, None] + fan
                there = below < tree.last_below[opened][:, None]
                a, c = np.repeat(at, FAN)[there.ravel()], below[there]
                frontier[a, c] = bounds(a, c)
            at, opened = active[leaf], column[leaf]
            if at.size:
                first = tree.first[opened][:, None] + fan
                there = first <= latest
                first, row = np.where(there, first, 0), rows[at][:, None]
                before = keys[row, first]
                there &= (before < NEVER) & ((first == 0) | (first >= least_days))
                _, cost = segment_costs(end - first, sums[row, end] - sums[row, first], squares[row, end] - squares[row, first])
                key = np.where(there, np.where(there, before, 0) + np.where(first > 0, cut, 0) + (cost << SHIFT) + 1, NEVER)
                pick = key.argmin(1)
                key, first = key[np.arange(at.size), pick], first[np.arange(at.size), pick]
                better = (key < best[at]) | ((key == best[at]) & (first < start[at]))
                best[at[better]], start[at[better]] = key[better], first[better]
        keys[rows, end], starts[rows, end] = best, start
    return keys, starts, sums, squares


def _cut(days: list[np.ndarray], totals: list[np.ndarray], least_days: int, penalty: int) -> list[tuple]:
    """Columns of SEGMENTS behind the series' place, of series given as sorted days and totals."""
    lengths = np.array([d[-1] - d[0] + 1 for d in days], np.int64)
    most = max(int(np.abs(t).max()) for t in totals)
    dense = np.zeros((len(days), int(lengths.max())), np.int64 if (most * int(lengths.max())) ** 2 < 1 << 62 else object)
    for i, (d, t) in enumerate(zip(days, totals, strict=True)):
        dense[i, d - d[0]] = t if dense.dtype != object else t.astype(object)
    keys, starts, sums, squares = best_cuts(dense, lengths, least_days, penalty)
    out = []
    for i, n in enumerate(lengths.tolist()):
        ends, best = [n], int(keys[i, n])
        while ends[-1]:
            ends.append(int(starts[i, ends[-1]]))
        edges = np.array(ends[::-1])
        a, z = edges[:-1], edges[1:]
        total = sums[i, z] - sums[i, a]
        spread, cost = segment_costs(z - a, total, squares[i, z] - squares[i, a])
        out += [(i, k + 1, int(days[i][0] + a[k]), int(z[k] - a[k]), int(total[k]), int(spread[k]), int(cost[k]), len(a), best >> SHIFT) for k in range(len(a))]
    return out


def segments(daily: DataFrame, least_days: int = LEAST_DAYS, penalty: int = PENALTY) -> DataFrame:
    """(key, columns of SEGMENTS): each key's series of (key, day, total) rows, from its first to its last day, cut at least cost.

    Days without a row count 0; days are distinct, as ``daily_totals`` makes them. A segment has at least ``least_days`` days;
    a shorter series is one segment. Of equally cheap cuts that of the fewest segments is taken, and of these that whose starts
    are earliest, compared from the last segment backwards. ``spread`` is V, ``best_cost`` the whole series' cost with ``penalty``
    for every cut. Negative totals are allowed; an empty table gives no rows. A series has one row a day and is cut within one
    task, whose memory grows with the days of its longest series and not with the rows behind them.
    """
    kind = daily.schema["key"].dataType.simpleString()
    series = daily.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("day", "total"))).alias("days"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("days")
            at, inside = column.offsets.to_numpy(), column.values
            day, total = (inside.field(x).to_numpy(zero_copy_only=False) for x in ("day", "total"))
            ranges = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            span = np.array([day[z - 1] - day[a] + 1 for a, z in ranges])
            order = np.argsort(span, kind="stable")[::-1]
            while order.size:  # the longest sets the width
                size = max(1, CELLS // int(span[order[0]]))
                chosen, order = order[:size], order[size:]
                found = _cut([day[slice(*ranges[i])] for i in chosen], [total[slice(*ranges[i])] for i in chosen], least_days, penalty)
                columns = list(zip(*found, strict=True))
                arrays = [batch.column("key").take(pa.array(chosen[list(columns[0])]))]
                arrays += [pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", *(x.split()[0] for x in SEGMENTS.split(", "))])

    bounded_batches(daily.sparkSession)
    return series.mapInArrow(run, f"key {kind}, {SEGMENTS}")
