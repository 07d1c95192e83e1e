"""Components of a large star and a long chain, and the tasks that make them."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import components


def test_a_large_star_and_a_long_chain(spark):
    star = spark.range(1, 300_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    chain = spark.range(2_000_000, 2_003_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = components.components(star.unionByName(chain).repartition(12)).groupBy("root").count()
    assert sorted(map(tuple, found.collect())) == [(0, 300_001), (2_000_000, 3_001)]


def test_edges_of_a_hot_node_stay_apart(spark, monkeypatch):
    """What the joins of a round make of a star, dealt over tasks: none has five times the median."""
    monkeypatch.setattr(components, "LARGE", 100_000)
    edges = spark.range(1, 200_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).repartition(16)
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    met = components._with_least(edges, least, 200_000)
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) >= 8 and max(sizes) < 5 * statistics.median(sizes)


@pytest.mark.parametrize("large", [0, 250_000])
def test_random_graphs(spark, monkeypatch, large):
    monkeypatch.setattr(components, "LARGE", large)
    draw = random.Random(3)
    for n, m in ((50, 30), (300, 200), (300, 600)):
        links = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(0, k) for k in range(0, n, 3)]
        root = list(range(n))
        for _ in range(n):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
        assert found == {x: root[x] for a, b in links if a != b for x in (a, b)}


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []
