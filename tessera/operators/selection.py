"""Selections: ranked picks, samples, set operations, frame strides and carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import hashed_order
from tessera.tables import written


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Column ``name``: 0-based position in the order, without a window over all rows.

    Rows are dealt by range of the order; each part's positions begin after the rows of the
    parts before it, whose counts are one row each.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "__part").withColumn(name, place + F.col("__before")).drop("__part", "__before")


def best_middle_worst(df: DataFrame, value: str, key: str, k: int = 6) -> DataFrame:
    """The k best, the k around the middle and the k worst rows, in that order of precedence; too few rows give fewer.

    Fewer than k rows give none; the middle needs 2 k.
    """
    n = df.count()
    if n < k:
        return df.limit(0).withColumns({"position": F.lit(0).cast("long"), "pick": F.lit("")})
    placed = numbered(df, [F.desc(value), F.asc(key)])
    middle = n // 2 - k // 2
    pick = F.when(F.col("position") < k, "best")
    if n >= 2 * k:
        pick = pick.when((F.col("position") >= middle) & (F.col("position") < middle + k), "middle")
    return placed.withColumn("pick", pick.when(F.col("position") >= n - k, "worst")).where(F.col("pick").isNotNull())


def small_middle_large(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Of each group the smallest, the median-position and the largest row; a row picked twice counts once."""
    w = Window.partitionBy(group).orderBy(value, key)
    n = F.count("*").over(Window.partitionBy(group))
    placed = df.withColumns({"position": F.row_number().over(w) - 1, "size": n})
    pick = F.when(F.col("position") == 0, "small").when(F.col("position") == F.floor(F.col("size") / 2), "middle").when(F.col("position") == F.col("size") - 1, "large")
    return placed.withColumn("pick", pick).where(F.col("pick").isNotNull())


def padded(picked: DataFrame, df: DataFrame, key: str, n: int) -> DataFrame:
    """``picked`` cut to n rows by key, or filled up with the first other rows by key."""
    have = picked.count()
    if have >= n:
        return picked.orderBy(key).limit(n)
    rest = df.join(picked.select(key), key, "left_anti").orderBy(key).limit(n - have)
    return picked.unionByName(rest.select(picked.columns))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in a repeatable random order; all if fewer."""
    return df.orderBy(hashed_order(F.col(key), seed), key).limit(n)


def first_occurrences(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the smallest ordinal for each key, by aggregation."""
    rest = [c for c in df.columns if c not in (*keys, ordinal)]
    return df.groupBy(*keys).agg(F.min(ordinal).alias(ordinal), *(F.min_by(c, ordinal).alias(c) for c in rest)).select(df.columns)


def missing_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of a that aren't in b (nulls are equal)."""
    return a.select(keys).subtract(b.select(keys))


def stride(df: DataFrame, index: str, fps: float, sample_fps: float, duration: float | None = None) -> DataFrame:
    """Frames at every max(1, round(fps / sample_fps))-th index, up to int(duration * fps)."""
    step = max(1, round(fps / sample_fps))
    kept = df.where(F.pmod(F.col(index), F.lit(step)) == 0)
    return kept if duration is None else kept.where(F.col(index) < int(duration * fps))


def held(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Column ``name``: the last non-null value up to each row of its group."""
    return df.withColumn(name, F.last(value, True).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def key_frames(df: DataFrame, group: str, order: list[str], shares: tuple[float, ...] = (0.2, 0.5, 0.8)) -> DataFrame:
    """Rows at floor(n * share) of each group, with the share."""
    placed = df.withColumns({"position": F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1, "size": F.count("*").over(Window.partitionBy(group))})
    share = F.explode(F.array(*(F.lit(s) for s in shares)))
    return placed.withColumn("share", share).where(F.col("position") == F.floor(F.col("size") * F.col("share"))).drop("size")


def running_best(df: DataFrame, group: str, order: list[str], value: str, patience: int) -> DataFrame:
    """best so far, rows since it improved, and whether training would have stopped by patience."""
    w = Window.partitionBy(group).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumns({"best": F.max(value).over(upto), "step": F.row_number().over(w)}).withColumn("improved", before.isNull() | (F.col(value) > before))
    since = marked.withColumn("waited", F.col("step") - F.max(F.when(F.col("improved"), F.col("step"))).over(upto))
    return since.withColumn("stopped", F.max((F.col("waited") >= patience).cast("int")).over(upto) == 1)


__all__ = ["best_middle_worst", "first_occurrences", "held", "key_frames", "missing_keys", "numbered", "padded", "running_best", "sample", "small_middle_large", "stride"]
