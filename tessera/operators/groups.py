"""Duplicate groups: transitive closure of edges, stable numbering, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.tables import written


def group_ids(records: DataFrame, key: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``key`` and duplicate_group_id of every record: records that edges connect share a group.

    Numbers go from 1 by size, larger first, then by the smallest member. Groups, not
    records, are numbered, by ranges of that order (see dense_numbers).
    """
    keys = records.select(F.col(key).alias("node")).distinct()
    linked = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).join(keys, F.col("u") == F.col("node"), "left_semi").join(keys, F.col("v") == F.col("node"), "left_semi")
    rooted = written(keys.join(components(linked), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "rooted")
    groups = rooted.groupBy("root").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    numbered = dense_numbers(groups, "size", "least").select("root", F.format_string("grp_%05d", F.col("number")).alias("duplicate_group_id"))
    return rooted.join(numbered, "root").select(F.col("node").alias(key), "duplicate_group_id")


def dense_numbers(groups: DataFrame, size: str, least: str) -> DataFrame:
    """Column ``number`` from 1, by size descending, then ``least``, without a window over all rows.

    Rows are dealt by range of the order; a part's numbers begin after the rows of the
    parts before it, whose counts are one row each.
    """
    ordered = groups.repartitionByRange(F.desc(size), F.asc(least)).withColumn("__part", F.spark_partition_id())
    ordered = written(ordered, "ordered")
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc(size), least))
    return ordered.join(F.broadcast(before), "__part").withColumn("number", inside + F.col("__before")).drop("__part", "__before")


def leaking_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose records lie in more than one split, with the sorted splits."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("n_splits"), F.concat_ws(",", F.sort_array(F.collect_set(split))).alias("splits")).where("n_splits > 1")


def assert_no_leakage(rows: DataFrame, group: str, split: str) -> DataFrame:
    """``rows`` unchanged; raises ValueError, naming the first five groups, if any group lies in two splits."""
    found = [r[0] for r in leaking_groups(rows, group, split).orderBy(group).limit(5).collect()]
    if found:
        raise ValueError(f"groups in more than one split: {', '.join(map(str, found))}")
    return rows


def group_report(rows: DataFrame, group: str, split: str) -> DataFrame:
    """One row: records, groups, groups of one and of several records, and groups that cross the original splits."""
    groups = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(split).alias("s"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("multi_groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("s") > 1).alias("crossing_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def group_profile(rows: DataFrame, group: str, disease: str, host: str, healthy: Column) -> DataFrame:
    """Size, most frequent disease and host (ties: the smallest), and whether all records are healthy."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.mode(disease, True).alias("disease"), F.mode(host, True).alias("host"), F.bool_and(healthy).alias("is_healthy"))
