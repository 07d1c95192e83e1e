"""Spearman's correlation by positions, against pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics


def of(spark, rows):
    return metrics.spearman(spark.createDataFrame(rows, "x double, y double").repartition(5), "x", "y").first()["spearman"]


@pytest.mark.parametrize("kind", ["distinct", "ties", "hot", "both"])
def test_against_pandas(spark, kind):
    draw = random.Random(len(kind))
    value = {"distinct": lambda: draw.gauss(0, 1), "ties": lambda: float(draw.randint(0, 12)), "hot": lambda: 5.0 if draw.random() < 0.9 else draw.gauss(5, 1), "both": lambda: float(draw.random() < 0.5)}[kind]
    rows = [(x := value(), x * 0.5 + value()) for _ in range(4_000)] + [(None, 1.0), (2.0, None)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = of(spark, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    frame = pd.DataFrame(rows, columns=["x", "y"]).dropna()
    assert found == pytest.approx(frame["x"].rank().corr(frame["y"].rank()), abs=1e-12)


def test_constant_side_and_no_rows(spark):
    assert of(spark, [(1.0, 2.0), (1.0, 3.0)]) is None and of(spark, []) is None


def test_a_value_in_most_rows_is_spread(spark):
    """One value in nine of ten distinct rows lies in many parts."""
    pairs = spark.range(200_000).select(F.when(F.col("id") % 10 > 0, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("t"), F.col("id").alias("p"), F.lit(1).cast("long").alias("c"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranked = metrics._placed(pairs, "t", "r")
    hot = ranked.where("t = 5").agg(F.count("*"), F.min("r"), F.max("r")).first()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    below = 1  # only 0.0 is smaller
    assert tuple(hot) == (180_000, below + 180_001 / 2, below + 180_001 / 2)
