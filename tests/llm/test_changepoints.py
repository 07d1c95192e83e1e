"""Change points against the plain recursion over all starts, and the query against SQL."""

import math
import random

import numpy as np
import pytest
from oracle import connection, rows
from pyspark.sql import functions as F

from tessera.llm import changepoints, queries
from tessera.llm.oracles import CHANGE_POINTS


def brute(values, least=7, penalty=20_000):
    """(total, segments, starts from the last backwards), the least of all cuts in that order."""

    def cost(a, z):
        n, part = z - a, values[a:z]
        return n * math.floor(1000 * math.log(1 + (n * sum(v * v for v in part) - sum(part) ** 2) // n**2))

    n = len(values)
    if n < least:
        return cost(0, n), 1, [0]
    best = {0: (0, 0, [])}
    for end in range(least, n + 1):
        found = [(t + cost(s, end) + penalty * (s > 0), k + 1, [s, *before]) for s, (t, k, before) in best.items() if s <= end - least]
        best[end] = min(found)
    return best[n]


@pytest.mark.parametrize("seed", range(12))
def test_against_every_cut(seed):
    draw = random.Random(seed)
    for n in (1, 6, 7, 8, 13, 14, 15, 29, 64, 71, 149):
        level, values = 10, []
        for _ in range(n):
            level = draw.choice([0, 5, 10, 100, 1000]) if draw.random() < 0.06 else level
            values.append(level if seed % 3 == 0 else max(0, int(draw.gauss(level, level * 0.3))))
        penalty = draw.choice([20_000, 20_000, 0, 100, 3_000])
        scale = 10**14 if seed == 1 else 1  # products beyond 64 bits
        found = changepoints._cut([np.arange(n) + 5], [np.array(values, np.int64) * scale], 7, penalty)
        total, count, starts = brute([v * scale for v in values], 7, penalty)
        assert [r[2] - 5 for r in found][::-1] == starts and {r[7:] for r in found} == {(count, total)}


def test_series_side_by_side_are_cut_alone():
    draw = np.random.default_rng(3)
    days = [np.arange(n) for n in (3, 40, 149, 7, 90)]
    totals = [draw.poisson(30, d.size) * (1 + 9 * (d > d.size // 2)) for d in days]
    together = changepoints._cut(days, totals, 7, 20_000)
    assert together == [(i, *r[1:]) for i in range(5) for r in changepoints._cut(days[i : i + 1], totals[i : i + 1], 7, 20_000)]


SCHEMA = "vendor_id long, shipped_at timestamp_ntz, quantity int, key string, day long, total long"


def _segments(spark, data):
    given = spark.createDataFrame(data, SCHEMA)
    daily = changepoints.daily_totals(given, "vendor_id", F.col("shipped_at"), F.col("quantity"))
    return changepoints.segments(daily).orderBy("key", "segment_no").collect()


def test_nulls_repeats_and_clashing_names(spark):
    import datetime as dt

    at = lambda k: dt.datetime(1969, 12, 25, 23, 59) + dt.timedelta(days=k)
    data = [(1, at(k), 2, "a", 9, 9) for k in (0, 0, 20)] + [(1, None, 5, "a", 0, 0), (1, at(2), None, "a", 0, 0), (None, at(0), 1, None, 0, 0)]
    found = _segments(spark, data + [(2, at(3), 7, "b", 0, 0)])
    assert [tuple(r) for r in found if r["key"] == 2] == [(2, 1, -4, 1, 7, 1, 0, 1, 0)]
    mine = [r for r in found if r["key"] == 1]
    assert sum(r["total"] for r in mine) == 6 and sum(r["n_days"] for r in mine) == 21 and mine[0]["first_day"] == -7
    total, count, starts = brute([4, *[0] * 19, 2])
    assert [r["first_day"] + 7 for r in mine][::-1] == starts and mine[0]["best_cost"] == total and mine[0]["n_segments"] == count


def test_empty_table(spark):
    assert _segments(spark, []) == []


def test_a_long_series_and_a_hot_key(spark):
    daily = spark.range(3_000).select(F.lit("x").alias("key"), (F.col("id") * 2).alias("day"), (F.col("id") % 7 + F.when(F.col("id") > 1500, 400).otherwise(0)).alias("total"))
    found = changepoints.segments(daily, penalty=2_000_000).collect()
    assert sum(r["n_days"] for r in found) == 5_999 and len(found) >= 2


def test_query_matches_sql(spark, folder):
    con = connection(folder)
    con.execute(f"CREATE OR REPLACE VIEW sale_lines AS SELECT * FROM '{folder}/sale_lines.parquet'")
    assert rows(queries.op13_change_points(spark, folder).toPandas()) == rows(con.execute(CHANGE_POINTS).fetch_df())
