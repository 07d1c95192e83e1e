"""Leakage-free splits: every duplicate group goes to one split, strata in order, by the largest relative deficit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import SPLITS, hashed_order
from tessera.tables import written

# Fixed value.
HEALTHY_STRATUM = "healthy_control"


def targets(n: int, train: float, val: float) -> dict[str, int]:
    """Rows wanted of each split, rounded half to even; test takes what is left."""
    a, b = round(n * train), round(n * val)
    return {"train": a, "val": b, "test": n - a - b}


def targets_of(n: Column, train: float, val: float) -> dict[str, Column]:
    """``targets`` of a column of counts."""
    a, b = (F.bround(n * F.lit(share), 0).cast("long") for share in (train, val))
    return {"train": a, "val": b, "test": n - a - b}


def stratum(host: Column, disease: Column, healthy: Column) -> Column:
    return F.when(healthy, F.lit(HEALTHY_STRATUM)).otherwise(F.concat_ws("___", host, disease))


def _shares(wanted: dict[str, int], split: str, current: int, size: int, n: int) -> np.ndarray:
    """What the fold compares for a split that holds ``current``: its relative deficit before each of ``n`` more groups of one size."""
    t = wanted[split]
    return (t - (current + size * np.arange(n, dtype=np.int64))) / max(1, t)


def _deficit(wanted: dict[str, int], split: str, current: int) -> float:
    return (wanted[split] - current) / max(1, wanted[split])


def fold_run(wanted: dict[str, int], current: dict[str, int], size: int, n: int) -> dict[str, int]:
    """How many of ``n`` groups of one ``size`` the fold gives each split, starting from ``current``, without the steps between.

    A split's deficits fall as it takes groups, so the fold takes the ``n`` largest of the three falling sequences, ties by the
    splits' order. A split takes its k-th group if fewer than ``n`` of all deficits come before that one; k is found by halving.
    """
    if size <= 0:  # nothing falls: the first best split takes all
        best = max(SPLITS, key=lambda s: _deficit(wanted, s, current[s]))
        return {s: n if s == best else 0 for s in SPLITS}

    def ahead(split: str, value: float, or_equal: bool) -> int:
        """How many deficits of a split are above ``value`` (or equal to it)."""
        low, high = 0, n
        while low < high:
            mid = (low + high) // 2
            d = _deficit(wanted, split, current[split] + size * mid)
            if d > value or or_equal and d == value:
                low = mid + 1
            else:
                high = mid
        return low

    taken = {}
    for i, split in enumerate(SPLITS):
        low, high = 0, n  # the split takes ``low`` groups at least
        while low < high:
            mid = (low + high) // 2
            value = _deficit(wanted, split, current[split] + size * mid)
            before = mid + sum(ahead(s, value, j < i) for j, s in enumerate(SPLITS) if j != i)
            if before < n:
                low = mid + 1
            else:
                high = mid
        taken[split] = low
    return taken


def _choices(wanted: dict[str, int], current: dict[str, int], size: int, n: int) -> np.ndarray:
    """The fold's split (its place in SPLITS) for each of ``n`` groups of one size in order."""
    taken = fold_run(wanted, current, size, n)
    if size <= 0:
        return np.full(n, next(i for i, s in enumerate(SPLITS) if taken[s]), np.int8)
    values = np.concatenate([_shares(wanted, s, current[s], size, taken[s]) for s in SPLITS])
    split = np.repeat(np.arange(len(SPLITS), dtype=np.int8), [taken[s] for s in SPLITS])
    return split[np.lexsort((split, -values))]


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(begin, end, size) of runs of equal values."""
    edges = np.flatnonzero(np.diff(sizes)) + 1
    for a, z in zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(sizes)]]).tolist(), strict=True):
        if z > a:
            yield a, z, int(sizes[a])


def _sorted(table: pa.Table) -> pa.Table:
    """A range's rows in the order that Spark dealt them by, nulls first."""
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("s", "o", "g")], null_placement="at_start"))


def greedy_splits(groups: DataFrame, group: str, size: str, stratum_column: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """``group`` and benchmark_split. The rule is a sequential fold: groups come by stratum, then in a repeatable
    random order; each goes to the split with the largest (target - current) / max(1, target), ties to train, val, test.

    Groups are dealt by ranges of that order. Each range reports its runs of groups of equal size; the driver folds a run at a
    time, in closed form, reads one range's runs at a time and keeps the three counters with which each range begins. From these all
    ranges find the same splits as the fold, side by side. No task and no list holds all groups; the driver's time grows with the number of runs.
    """
    narrow = groups.select(F.col(group).cast("string").alias("g"), F.col(size).cast("long").alias("n"), F.col(stratum_column).alias("s"))
    dealt = narrow.withColumn("o", hashed_order(F.col("g"), seed)).repartitionByRange("s", "o", "g").withColumn("part", F.spark_partition_id()).sortWithinPartitions("s", "o", "g")
    dealt = written(dealt, "split-groups")
    total = dealt.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = targets(int(total), train, val)

    def runs(key: tuple, table: pa.Table) -> pa.Table:
        found = list(_runs(_sorted(table).column("n").to_numpy()))
        part = pa.array([key[0].as_py()] * len(found), pa.int32())
        return pa.table({"part": part, "place": pa.array(range(len(found)), pa.int64()), "size": pa.array([s for _, _, s in found], pa.int64()), "n": pa.array([z - a for a, z, _ in found], pa.int64())})

    told = written(dealt.select("part", "n", "s", "o", "g").groupBy("part").applyInArrow(runs, "part int, place long, size long, n long"), "split-runs")
    current, begins = dict.fromkeys(SPLITS, 0), []
    for run in told.orderBy("part", "place").toLocalIterator(prefetchPartitions=True):
        if not begins or begins[-1][0] != run["part"]:
            begins.append((run["part"], *current.values()))
        for split, n in fold_run(wanted, current, run["size"], run["n"]).items():
            current[split] += n * run["size"]
    states = groups.sparkSession.createDataFrame(begins, "at int, " + ", ".join(f"{s} long" for s in SPLITS))

    def replay(key: tuple, table: pa.Table) -> pa.Table:
        table = _sorted(table)
        state = {s: table.column(s)[0].as_py() for s in SPLITS}
        chosen = np.empty(len(table), np.int8)
        for a, z, size_ in _runs(table.column("n").to_numpy()):
            chosen[a:z] = _choices(wanted, state, size_, z - a)
            for i, s in enumerate(SPLITS):
                state[s] += int((chosen[a:z] == i).sum()) * size_
        return pa.table({"g": table.column("g"), "benchmark_split": pa.array(SPLITS).take(pa.array(chosen))})

    known = dealt.join(F.broadcast(states), F.col("part") == F.col("at")).drop("at")
    return known.groupBy("part").applyInArrow(replay, "g string, benchmark_split string").withColumnRenamed("g", group)


def assigned(rows: DataFrame, splits: DataFrame, group: str, default: str = "train") -> DataFrame:
    """``rows`` with the split of their group; groups without one get the default."""
    return rows.join(splits, group, "left").withColumn("benchmark_split", F.coalesce("benchmark_split", F.lit(default)))


def exclusion_reason(valid_image: Column, image_error: Column, disease: Column, healthy: Column, selected: list[str], healthy_enabled: bool, valid_mask: Column, mask_error: Column, affected: Column, exclude_anomalous: bool = True) -> Column:
    """Why a record is left out, null if it isn't; the first condition that holds decides."""
    reason = F.when(~valid_image, F.concat(F.lit("Corrupt or unreadable image: "), F.coalesce(image_error, F.lit("None"))))
    reason = reason.when(healthy, F.lit(None).cast("string") if healthy_enabled else F.lit("Healthy control excluded by configuration policy"))
    reason = reason.when(~F.lower(F.trim(disease)).isin(*selected), F.concat(F.lit("Class '"), disease, F.lit("' not in selected benchmark subset")))
    if exclude_anomalous:
        reason = reason.when(~valid_mask | (affected == 0), F.concat(F.lit("Anomalous/empty mask for diseased sample: "), F.coalesce(mask_error, F.lit("Zero lesion pixels"))))
    return reason


def healthy_allowed(diseased: int, ratio: float, pool: int) -> int:
    """Healthy records that make up at most ``ratio`` of the whole, rounded half to even; all of them from a ratio of 1."""
    return pool if ratio >= 1 else round(diseased * ratio / (1 - ratio))


def healthy_cap(rows: DataFrame, key: str, healthy: str, ratio: float, seed: int = 42) -> DataFrame:
    """Column ``capped``: healthy records beyond the allowed number, in a repeatable random order.

    Healthy records are dealt by range of the order; counts of the ranges tell which holds the
    last allowed record, and only that range is sorted. Rows after that record are capped.
    """
    counts = rows.agg(F.count_if(~F.col(healthy)).alias("d"), F.count_if(F.col(healthy)).alias("h")).first()
    allowed = healthy_allowed(counts["d"], ratio, counts["h"])
    if allowed >= counts["h"]:
        return rows.withColumn("capped", F.lit(False))
    order = hashed_order(F.col(key), seed)
    if allowed <= 0:
        return rows.withColumn("capped", F.col(healthy))
    dealt = rows.where(F.col(healthy)).select(order.alias("o"), F.col(key).alias("k")).repartitionByRange("o", "k").withColumn("part", F.spark_partition_id())
    dealt, before, chosen = written(dealt, "healthy"), 0, None
    for part, n in sorted(tuple(r) for r in dealt.groupBy("part").count().collect()):  # one row a range
        chosen = part
        if before + n >= allowed:
            break
        before += n
    last = dealt.where(F.col("part") == chosen).orderBy("o", "k").offset(allowed - before - 1).limit(1)
    beyond = F.struct(order.alias("o"), F.col(key).alias("k")) > F.struct("__o", "__k")
    return rows.crossJoin(F.broadcast(last.select(F.col("o").alias("__o"), F.col("k").alias("__k")))).withColumn("capped", F.col(healthy) & beyond).drop("__o", "__k")
