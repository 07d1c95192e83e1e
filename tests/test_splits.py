"""The fold by runs against the fold by groups."""

import random

import pytest

from tessera.functions.scalars import SPLITS
from tessera.operators import splits


def plain(wanted, sizes, current):
    out = []
    for n in sizes:
        best = max(SPLITS, key=lambda s: (wanted[s] - current[s]) / max(1, wanted[s]))
        current[best] += n
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_a_run_in_closed_form(seed):
    draw = random.Random(seed)
    for _ in range(150):
        total = draw.choice([0, 1, 7, 100, 5_000, 10**12])
        wanted = splits.targets(total, draw.choice([0.7, 0.5, 1 / 3, 0.0, 1.0]), draw.choice([0.15, 0.25, 0.0]))
        start = {s: draw.choice([0, 0, draw.randrange(total + 5)]) for s in SPLITS}
        size, n = draw.choice([0, 1, 1, 2, 3, 50]), draw.choice([1, 2, 3, 20, 257])
        chosen = plain(wanted, [size] * n, dict(start))
        assert splits.fold_run(wanted, dict(start), size, n) == {s: chosen.count(s) for s in SPLITS}
        assert [SPLITS[i] for i in splits._choices(wanted, dict(start), size, n)] == chosen


def test_many_ranges_give_the_plain_fold(spark):
    draw = random.Random(1)
    rows = [(f"g{i:05d}", draw.choice([1, 1, 1, 1, 2, 9, 40]), draw.choice(["a", "b", None])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, n long, s string")
    order = df.withColumn("o", splits.hashed_order(splits.F.col("g"), 42)).orderBy("s", "o", "g").collect()
    wanted = splits.targets(sum(r[1] for r in rows), 0.7, 0.15)
    chosen = plain(wanted, [r["n"] for r in order], dict.fromkeys(SPLITS, 0))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    found = {r["g"]: r["benchmark_split"] for r in splits.greedy_splits(df, "g", "n", "s").collect()}
    for k, v in before.items():
        spark.conf.set(k, v)
    assert found == dict(zip([r["g"] for r in order], chosen, strict=True))


def test_no_groups(spark):
    assert splits.greedy_splits(spark.createDataFrame([], "g string, n long, s string"), "g", "n", "s").collect() == []
