"""Bit-sliced search against plain integer products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitsliced


def brute(rows, k):
    held = [(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _ in held if i % 20 == 0}:  # rows that share an id ask together, and don't answer each other
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for x, q in held if x == i for j, v in held if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def found(spark, rows, k=20, kind="array<float>", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, block int, n string" if rows and len(rows[0]) == 4 else f"vec_id long, embedding {kind}")
    index = bitsliced.index(df, F.col("vec_id") % 20 == 0, **{x: y for x, y in how.items() if x == "block_rows"})
    return sorted(tuple(r)[:4] for r in bitsliced.search(index, k, **{x: y for x, y in how.items() if x != "block_rows"}).collect())


@pytest.mark.parametrize(("spread", "k", "block"), [(0.3, 20, 64), (0.02, 5, 50), (3.0, 20, 1000)])
def test_matches_brute_force_with_ties(spark, spread, k, block):
    rng = np.random.default_rng(int(spread * 100))
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, 8)]) for i in rng.permutation(300)]
    assert found(spark, rows, k, block_rows=block, queries_at_once=4) == brute(rows, k)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (0, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [None, 0.1]), (4, [nan, 0.1]), (5, [inf, 0.1]), (None, [0.1, 0.1]), (20, [-0.5, 0.0]), (7, [0.5, 0.5]), (9, [0.1])]
    padded = [(i, v if v is None else v + [0.0] * (2 - len(v))) for i, v in rows]
    assert found(spark, rows) == brute(padded, 20)


def test_empty_and_single(spark):
    assert found(spark, []) == [] and found(spark, [(20, [1.0])]) == [] and found(spark, [(3, [1.0])]) == []


def test_other_columns(spark):
    rows = [(i, [i / 100], 7, "x") for i in range(50)]
    assert found(spark, rows) == brute([r[:2] for r in rows], 20)


def test_adders():
    rng = np.random.default_rng(1)
    maps = [(int(t), rng.integers(0, 2**63, 3, dtype=np.uint64)) for t in rng.integers(0, 5, 40)]
    weighted = [[] for _ in range(5)]
    for t, m in maps:
        weighted[t].append(m)
    slices = bitsliced.add_up(weighted)
    for row in (0, 63, 64, 190):
        bit = lambda m: int(m[row // 64] >> np.uint64(row % 64)) & 1  # noqa: B023, E731
        assert sum(bit(s) << t for t, s in enumerate(slices)) == sum(bit(m) << t for t, m in maps)
