"""Quantiles dealt by range against numpy's."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.quantiles import Quantile, median, summary

SHARES = (0.0, 0.25, 0.5, 0.9, 1.0)


def named(value):
    return {"rows": F.count("*"), "least": F.min(value)} | {f"q{i}": Quantile(value, p) for i, p in enumerate(SHARES)} | {"low": Quantile(value, 0.5, lower=True), "other": median(value + 1, -1.0)}


def expected(values):
    kept = sorted(v for v in values if v is not None)
    if not kept:
        return (len(values), None, *(None for _ in SHARES), None, -1.0)
    low = kept[max(1, -(-len(kept) // 2)) - 1]
    return (len(values), kept[0], *(float(np.quantile(kept, p)) for p in SHARES), low, float(np.median(kept)) + 1)


@pytest.mark.parametrize("key", ["source", "n"])
def test_groups(spark, key):
    """Groups of all sizes, a value that is most of a group, nulls as values and keys; keys named as inner columns might be."""
    rng = random.Random(5)
    groups = {"a": [7.0] * 400 + [float(i) for i in range(100)], "b": [rng.gauss(0, 9) for _ in range(901)], "c": [None, 2.5], "d": [None], None: [1.0, 4.0, 4.0]}
    rows = [(k, v) for k, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"{key} string, x double").repartition(5)
    found = {r[key]: tuple(r)[1:] for r in summary(df, [key], named(F.col("x"))).collect()}
    assert found.keys() == groups.keys()
    for k, values in groups.items():
        assert found[k] == pytest.approx(expected(values), abs=1e-9), k


def test_all_rows_and_no_rows(spark):
    df = spark.createDataFrame([(float(i % 977),) for i in range(5000)], "x double")
    assert tuple(summary(df, [], named(F.col("x"))).first()) == pytest.approx(expected([float(i % 977) for i in range(5000)]))
    assert tuple(summary(df.limit(0), [], named(F.col("x"))).first()) == (0, *(None,) * 7, -1.0)
    assert summary(df.limit(0), ["x"], {"m": median(F.col("x"))}).count() == 0
