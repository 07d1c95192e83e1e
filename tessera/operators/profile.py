"""Profiles of record tables: counts, cross tables, numeric summaries, weights and histograms. Values are unrounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio
from tessera.operators.quantiles import Quantile, median, summary


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each value; null is a value of its own."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(key, "n", ratio(100.0 * F.col("n"), F.col("total")).alias("percentage"))


def present_counts(df: DataFrame, key: str) -> DataFrame:
    """Count of each value that isn't null."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def cross_table(df: DataFrame, row: str, column: str, total: str = "Total") -> DataFrame:
    """Long cross table with margins, named ``total``; one pass by grouping sets. Rows with a null key are left out."""
    cube = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("gr"), F.grouping(column).alias("gc"))
    name = lambda c, g: F.when(F.col(g) == 1, F.lit(total)).otherwise(F.col(c).cast("string")).alias(c)
    return cube.select(name(row, "gr"), name(column, "gc"), "n")


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A column for each of the given values, 0 where none occurs, and the row's total over these values."""
    counts = df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))
    return counts.withColumn("total", sum((F.col(v) for v in values), F.lit(0)))


def numeric_profile(value: Column) -> dict[str, Column | Quantile]:
    """Aggregates of a numeric column: sample deviation is 0 for one value; all but the count are null without values."""
    v = value.cast("double")
    return {
        "n": F.count(v), "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "median": median(v),
        "std": F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)), "p25": Quantile(v, 0.25), "p75": Quantile(v, 0.75),
    }


def profile(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row for each named expression."""
    wide = summary(df, [], {f"{name}__{k}": c for name, e in columns.items() for k, c in numeric_profile(e).items()})
    kinds = ("n", "min", "max", "mean", "median", "std", "p25", "p75")
    return wide.select(F.explode(F.array(*(F.struct(F.lit(name).alias("column"), *(F.col(f"{name}__{k}").alias(k) for k in kinds)) for name in columns))).alias("p")).select("p.*")


def aspect(width: Column, height: Column) -> Column:
    return F.try_divide(width.cast("double"), height.cast("double"))


def describe_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, mean, std (null for one row), min, quartiles and max of each group."""
    v = F.col(value).cast("double")
    named = {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "p25": Quantile(v, 0.25), "p50": median(v), "p75": Quantile(v, 0.75), "max": F.max(v)}
    return summary(df.where(F.col(key).isNotNull()), [key], named)


def top_values(df: DataFrame, key: Column, k: int, name: str = "value") -> DataFrame:
    """The k most frequent values; ties go to the smaller value."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def distinct_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct count and sorted distinct values of each key. The lists are as long as the keys have values."""
    wide = df.agg(*(c for k in keys for c in (F.countDistinct(k).alias(f"{k}__n"), F.concat_ws(",", F.sort_array(F.collect_set(F.col(k).cast("string")))).alias(f"{k}__v"))))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"{k}__n").alias("n_distinct"), F.col(f"{k}__v").alias("values")) for k in keys))).alias("s")).select("s.*")


def conditional_profile(df: DataFrame, keys: list[str], valid: Column, masked: Column, value: str, split: str, splits: tuple[str, ...]) -> DataFrame:
    """Per group: totals, valid rows, valid masks, rows of each split, and the ratio's median, mean, min and max over valid masks (0 without any)."""
    v = F.when(masked, F.col(value).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    named = {"total": F.count("*"), "valid_images": F.count_if(valid), "valid_masks": F.count_if(masked)} | {f"{s}_count": F.count_if(F.col(split) == s) for s in splits}
    named |= {"median_ratio": median(v, 0.0), "mean_ratio": zero(F.avg(v)), "min_ratio": zero(F.min(v)), "max_ratio": zero(F.max(v))}
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return summary(rows, keys, named)


def feasibility(profiled: DataFrame, tiers: tuple[tuple[str, int, int], ...]) -> DataFrame:
    """Tier of each class, best first in ``tiers`` as (name, least rows, least masks); both must hold. Classes below all are Insufficient.

    The rationale names what is missing for the lowest tier. Ordered by tier, rows, masks, then the keys' order of columns.
    """
    total, masks = F.col("total"), F.col("valid_masks")
    tier, rank = F.lit("Insufficient"), F.lit(len(tiers))
    for k, (name, rows, least) in reversed(list(enumerate(tiers))):
        fits = (total >= rows) & (masks >= least)
        tier, rank = F.when(fits, name).otherwise(tier), F.when(fits, k).otherwise(rank)
    _, rows, least = tiers[-1]
    missing = F.concat_ws(", ", F.when(total < rows, F.concat(F.lit("rows "), total.cast("string"), F.lit(f" < {rows}"))), F.when(masks < least, F.concat(F.lit("masks "), masks.cast("string"), F.lit(f" < {least}"))))
    return profiled.select("*", tier.alias("tier"), rank.alias("tier_rank"), F.when(rank == len(tiers), missing).otherwise(F.lit("")).alias("rationale"))


def class_weights(df: DataFrame, key: str, learns: Column, most: float = 10.0) -> DataFrame:
    """total / (classes * count) over the rows to learn from, clipped to [0, most]. Classes without such rows get 0."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(learns).alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    weight = ratio(F.col("total"), F.col("k") * F.col("n"), 0.0)
    return counts.crossJoin(F.broadcast(totals)).select(key, "n", F.greatest(F.lit(0.0), F.least(F.lit(most), weight)).alias("weight"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum; the maximum falls into the last bin. Null values are left out.

    A single distinct value falls into bin 0. Empty bins have no row.
    """
    v = F.col(value).cast("double")
    edges = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    place = F.floor(F.coalesce(F.try_divide((v - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0)))
    return df.where(v.isNotNull()).crossJoin(F.broadcast(edges)).groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))


def box_plot(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles and whiskers (the outermost values within 1.5 interquartile ranges) and the number of values beyond."""
    v = F.col(value).cast("double")
    q = summary(df.where(F.col(key).isNotNull()), [key], {"q1": Quantile(v, 0.25), "q2": median(v), "q3": Quantile(v, 0.75)})
    inside = (v >= F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) & (v <= F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return df.join(q, key).groupBy(key).agg(F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("q3").alias("q3"), F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("outliers"))


def flat_metrics(row: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """A one-row table as (category, name, value), values as strings."""
    return row.select(F.explode(F.array(*(F.struct(F.lit(g).alias("category"), F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for g, names in groups.items() for n in names))).alias("m")).select("m.*")


def target_statistics(df: DataFrame, value: str, split: str, healthy: Column) -> DataFrame:
    """One row: rows in all, of each split and healthy ones, and mean, median, deviation, range and quartiles of the train rows' target."""
    train = F.when(F.col(split) == "train", F.col(value).cast("double"))
    named = {"total_samples": F.count("*")} | {f"{s}_samples": F.count_if(F.col(split) == s) for s in ("train", "val", "test")} | {"healthy_samples": F.count_if(healthy)}
    statistics = {"mean": F.avg(train), "median": median(train), "std": F.stddev_samp(train), "min": F.min(train), "max": F.max(train), "q25": Quantile(train, 0.25), "q75": Quantile(train, 0.75)}
    return summary(df, [], named | {f"target_train_{k}": c for k, c in statistics.items()})


def manifest_summary(df: DataFrame, split: str, label: str, healthy: Column, value: str) -> DataFrame:
    """One row: records, those of each split with percentages of two digits, diseased and healthy ones, distinct
    labels, and the mean and median value of the diseased ones."""
    sick = F.when(~healthy, F.col(value).cast("double"))
    named = {"total": F.count("*")} | {s: F.count_if(F.col(split) == s) for s in ("train", "val", "test")}
    named |= {"diseased": F.count_if(~healthy), "healthy": F.count_if(healthy), "classes": F.count_distinct(label), "mean_value": F.avg(sick), "median_value": median(sick)}
    counts = summary(df, [], named)
    return counts.withColumns({f"{s}_percent": F.round(ratio(100.0 * F.col(s), F.col("total")), 2) for s in ("train", "val", "test")})


def frequency_map(df: DataFrame, key: str) -> DataFrame:
    """One row: a map from each value that isn't null to its count, in the order of the values. For keys of few values."""
    pairs = present_counts(df, key).agg(F.sort_array(F.collect_list(F.struct(F.col(key), F.col("n")))).alias("pairs"))
    return pairs.select(F.map_from_entries("pairs").alias("frequencies"))
