"""Connected components of large graphs by alternating stars; nothing is gathered on the driver but one sum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import written

#: A node is hot that has at least one in so many of the edges' ends. There are no more hot nodes than this, so they are broadcast.
HOT_ONE_IN = 2_048
#: Graphs of fewer ends have no node that one task couldn't hold; their joins are left to Spark, which saves the driver many small broadcasts.
LARGE = 250_000


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
    return row["n"], row["s"]


def _with_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """``edges`` (u, v) with the ``m`` of their u. Edges of hot nodes stay where they are and learn it by broadcast; the others are joined."""
    if ends < LARGE:
        return edges.join(least.select("u", "m"), "u")
    hot = least.where(F.col("degree") * HOT_ONE_IN >= ends).select(F.col("u").alias("__hot"), F.col("m").alias("__m"))
    marked = edges.join(F.broadcast(hot), F.col("u") == F.col("__hot"), "left")
    cold = marked.where("__hot IS NULL").select("u", "v").join(least.select("u", "m"), "u")
    return marked.where("__hot IS NOT NULL").select("u", "v", F.col("__m").alias("m")).unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v of one ordered type): root is the smallest node of its component.

    Each round hangs every node's larger neighbours on the smallest one (large star), then
    the smaller ones too (small star), until no edge changes; the number of rounds grows with
    the logarithm of the size. Smallest neighbours are aggregated before the shuffle, and the edges of
    a node with many neighbours, as roots have, are never brought together (see ``_with_least``). Every round is
    written to the shared folder, which cuts the lineage. Loops and repeated edges are
    ignored; without edges the result is empty.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _checksum(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = _with_least(both, least, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        hung = _with_least(large, least, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _checksum(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
