"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.tables import bounded_batches, fresh_path, shared_dir, table, written

__all__ = ["bounded_batches", "buckets", "fresh_path", "hot_keys", "shared_dir", "spread_join", "table", "written"]


#: Estimates beyond this are those of plans whose size Spark doesn't know.
UNKNOWN_BYTES = 1 << 50


def buckets(df: DataFrame, bytes_each: int) -> int:
    """How many buckets of about ``bytes_each`` the plan's estimated input makes; grows with the input.

    Where Spark has no estimate, a multiple of the shuffle partitions stands for it.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 32 * shuffle if size > UNKNOWN_BYTES else max(4 * shuffle, size // bytes_each + 1)


#: A key is hot that has at least one in so many rows; there can't be more hot keys than this, so they are broadcast.
HOT_ONE_IN = 2_048
#: Parts into which the rows of a hot key are dealt.
HOT_PARTS = 64


def hot_keys(counted: DataFrame, key: str, rows: int, count: str = "copies") -> DataFrame:
    """Of a table of distinct keys and their counts those that have a share of 1 / HOT_ONE_IN of ``rows`` or more."""
    return counted.where(F.col(count) * HOT_ONE_IN >= rows).select(key)


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, by: list[Column], how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (a row for each key) on ``key``; rows of hot keys, and with a null key, are dealt over
    many tasks by the hash of ``by``, and the row of a hot key goes to each of their parts."""
    flags = F.broadcast(hot.select(F.col(key).alias("__hot")))
    part = F.pmod(F.xxhash64(*by), F.lit(HOT_PARTS)).cast("int")
    left = many.join(flags, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), part).otherwise(0)).drop("__hot")
    parts = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(flags, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return left.join(right, [key, "__part"], how).drop("__part")
