"""Exact quantiles beside other aggregates, without a task that holds all values of a group.

Values are counted, the counts are dealt by range of (group, value), and sums of the ranges
tell where each begins; a quantile is then the value whose run of positions covers the wanted
one. A group of any size is spread over many tasks, and a value that is very frequent is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import written


@dataclass(frozen=True)
class Quantile:
    """The quantile ``share`` of a numeric expression: interpolated, or the smallest value that reaches the share
    (``lower``); ``empty`` stands for it where there are no values. Nulls are left out."""

    value: Column
    share: float
    lower: bool = False
    empty: float | None = None


def median(value: Column, empty: float | None = None) -> Quantile:
    return Quantile(value, 0.5, empty=empty)


def summary(rows: DataFrame, keys: list[str], named: dict[str, Column | Quantile]) -> DataFrame:
    """``keys`` and the named aggregates of each group (of all rows without keys: one row, also for no rows).

    Names beginning with ``__`` are reserved."""
    wanted = {k: q for k, q in named.items() if isinstance(q, Quantile)}
    totals = rows.groupBy(*keys).agg(F.count("*").alias("__rows"), *(c.alias(k) for k, c in named.items() if k not in wanted))
    found = quantiles(rows, keys, wanted).withColumnsRenamed({k: f"__of_{k}" for k in keys})
    if keys:
        same = F.lit(True)
        for k in keys:
            same &= totals[k].eqNullSafe(found[f"__of_{k}"])
        joined = totals.join(found, same, "left")
    else:
        joined = totals.crossJoin(F.broadcast(found))  # one row each
    filled = {k: F.col(k) if q.empty is None else F.coalesce(F.col(k), F.lit(q.empty)).alias(k) for k, q in wanted.items()}
    return joined.select(*keys, *(filled.get(k, F.col(k)) for k in named))


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, Quantile]) -> DataFrame:
    """``keys`` and the wanted quantiles of each group that has values (without keys: one row)."""
    sources = {id(q.value): q.value for q in wanted.values()}
    place = {k: i for i, k in enumerate(sources)}
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("__source"), v.cast("double").alias("__v")) for i, v in enumerate(sources.values()))))
    counted = rows.select(*keys, values.alias("__s")).select(*keys, "__s.__source", "__s.__v").where("__v IS NOT NULL").groupBy(*keys, "__source", "__v").agg(F.count("*").alias("__n"))
    dealt = written(counted.repartitionByRange(*keys, "__source", "__v").withColumn("__part", F.spark_partition_id()), "quantiles")
    group = Window.partitionBy(*keys, "__source")
    sizes = dealt.groupBy(*keys, "__source", "__part").agg(F.sum("__n").alias("__size"))  # a row for each group and range
    sizes = sizes.select(
        *(F.col(k).alias(f"__of_{k}") for k in keys), F.col("__source").alias("__side_source"), F.col("__part").alias("__side_part"), F.sum("__size").over(group).alias("__total"),
        F.coalesce(F.sum("__size").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    same = (F.col("__source") == F.col("__side_source")) & (F.col("__part") == F.col("__side_part"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__source", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = dealt.withColumn("__upto", upto).join(sizes, same).withColumns({"__end": F.col("__before") + F.col("__upto"), "__begin": F.col("__before") + F.col("__upto") - F.col("__n")})

    def covers(position: Column, q: Quantile) -> Column:
        return (F.col("__source") == place[id(q.value)]) & (F.col("__begin") <= position) & (position < F.col("__end"))

    chosen, out, parts = F.lit(False), [], []
    for name, q in wanted.items():
        if q.lower:
            at = F.greatest(F.ceil(F.col("__total") * F.lit(q.share)), F.lit(1)) - 1
            chosen |= covers(at, q)
            parts.append(F.max(F.when(covers(at, q), F.col("__v"))).alias(name))
            out.append(F.col(name))
            continue
        at = (F.col("__total") - 1) * F.lit(float(q.share))
        low, high = F.floor(at), F.ceil(at)
        chosen |= covers(low, q) | covers(high, q)
        of = F.col("__source") == place[id(q.value)]
        parts += [F.max(F.when(covers(low, q), F.col("__v"))).alias(f"{name}__low"), F.max(F.when(covers(high, q), F.col("__v"))).alias(f"{name}__high"), F.max(F.when(of, at)).alias(f"{name}__at")]
        a, b, x = F.col(f"{name}__low"), F.col(f"{name}__high"), F.col(f"{name}__at")
        out.append(F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b).alias(name))
    return runs.where(chosen).groupBy(*keys).agg(*parts).select(*keys, *out)
