"""Classes of duplicates against all pairs, and the fingerprint index against comparing all fingerprints."""

import itertools
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import classes, duplicates, fingerprints

SPLITS = ["train", "Val", "validation", "test", "unassigned", None, "extra"]


def records(spark, n=300, seed=1):
    draw = random.Random(seed)
    rows = [(i, draw.choice(["a", "a", "a", "b", "c", None, f"x{draw.randint(0, 40)}"]), draw.choice(SPLITS), "z") for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, digest string, split string, n string").repartition(7)


def counted(pairs):
    """Counters of pairs of splits, by the rules for one pair."""
    plain = lambda s: "val" if (s or "").lower() == "validation" else (s or "").lower()
    free = lambda s: (s or "unassigned").lower()
    by = Counter(frozenset((plain(a), plain(b))) for a, b in pairs)
    cross = sum(free(a) != free(b) and "unassigned" not in (free(a), free(b)) for a, b in pairs)
    return (len(pairs), cross, *(by[frozenset(x)] for x in duplicates.LEAKS))


def test_counters_membership_and_stars(spark):
    rows, df = records(spark)
    found, members = classes.audited(df, "k", "digest", "split", ["split"])
    held = [r for r in rows if r[1] is not None]
    pairs = [(a, b) for a, b in itertools.combinations(held, 2) if a[1] == b[1]]
    assert tuple(classes.exact_counters(found).first()) == counted([(a[2], b[2]) for a, b in pairs])
    least = {d: min(r[0] for r in held if r[1] == d) for _, d, _, _ in held}
    assert {r["k"]: r["representative"] for r in members.collect()} == {r[0]: least[r[1]] for r in held}
    stars = classes.star_edges(members, found, "k", ["split"]).collect()
    split = {r[0]: r[2] for r in rows}
    assert sorted((r["k_1"], r["k_2"]) for r in stars) == sorted((least[r[1]], r[0]) for r in held if r[0] != least[r[1]])
    assert all(r["split_1"] == split[r["k_1"]] and r["split_2"] == split[r["k_2"]] for r in stars)
    asked = df.where("k IN (3, 4, 299)").select("k")
    assert sorted(map(tuple, classes.pairs_of(members, asked, "k").collect())) == sorted((a[0], b[0]) for a, b in pairs if {a[0], b[0]} & {3, 4, 299})


def test_near_counters_stand_for_pairs(spark):
    rows, df = records(spark, 120, 2)
    found, _ = classes.audited(df, "k", "digest", "split", ["split"])
    ids = sorted(r["representative"] for r in found.collect())
    linked = [(a, b, 1) for a, b in itertools.combinations(ids, 2) if (a + b) % 3 == 0]
    near = classes.near_class_pairs(spark.createDataFrame(linked, "representative_1 long, representative_2 long, distance int"), found, ["split"])
    at = {r[0]: r[1] for r in rows}
    of = {(at[a], at[b]) for a, b, _ in linked}
    pairs = [(a[2], b[2]) for a, b in itertools.combinations(rows, 2) if (a[1], b[1]) in of or (b[1], a[1]) in of]
    assert tuple(classes.near_counters(near).first()) == counted(pairs)
    assert tuple(classes.near_counters(near.limit(0)).first()) == (0,) * 5 == tuple(classes.exact_counters(found.limit(0)).first())


def test_a_class_with_a_third_of_all_records(spark):
    df = spark.range(300_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("digest"), F.lit("train").alias("split"))
    found, members = classes.audited(df, "k", "digest", "split", [])
    assert classes.exact_counters(found).first()["pairs"] == 100_000 * 99_999 // 2 and members.where("representative = 0").count() == 100_000


def hashes(n, seed=0):
    draw = random.Random(seed)
    out = [draw.getrandbits(256) for _ in range(n)]
    for _ in range(n):
        h = draw.choice(out)
        for _ in range(draw.randint(0, 8)):
            h ^= 1 << draw.randrange(256)
        out.append(h)
    return out + [draw.getrandbits(20) for _ in range(60)] + [draw.getrandbits(30) << 200 for _ in range(60)]  # most blocks blank


def frame(spark, values):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, [signed(h >> (192 - 64 * w) & ((1 << 64) - 1)) for w in range(4)], 1) for i, h in enumerate(values)]
    return spark.createDataFrame([*rows, (-1, None, 1)], "k long, w array<bigint>, block int")


def name():
    return f"index_{uuid.uuid4().hex}"


@pytest.mark.parametrize("shared", [2, 10_000])
def test_index_finds_all_pairs_once(spark, shared):
    values = hashes(150)
    index = fingerprints.build(frame(spark, values), "k", "w", name(), shared=shared, buckets=8)
    wanted = sorted((i, j, (a ^ b).bit_count()) for (i, a), (j, b) in itertools.combinations(enumerate(values), 2) if (a ^ b).bit_count() <= 6)
    assert sorted(map(tuple, fingerprints.near_pairs(index, spark).collect())) == wanted and len(wanted) > 200


def test_probe_moves_its_own_rows_only(spark):
    values = hashes(120, 3)
    df = frame(spark, values)
    index = fingerprints.build(df.where("k % 2 = 0"), "k", "w", name(), buckets=8)
    found = fingerprints.probe(index, df.where("k % 2 = 1"), "k", "w")
    wanted = sorted((j, i, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i % 2 == 0 and j % 2 == 1 and (a ^ b).bit_count() <= 6)
    assert sorted(map(tuple, found.collect())) == wanted and wanted
    initial = lambda df: df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2] or df._jdf.queryExecution().executedPlan().toString()
    assert initial(found).count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in initial(found)
    assert "Exchange" not in initial(fingerprints.near_pairs(index, spark))
    fingerprints.add(index, df.where("k % 2 = 1"), "k", "w")
    everything = sum((a ^ b).bit_count() <= 6 for a, b in itertools.combinations(values, 2))
    assert fingerprints.near_pairs(index, spark).count() == everything


def test_few_candidates(spark):
    draw = random.Random(4)
    base = [draw.getrandbits(256) for _ in range(3_000)]
    values = base + [h ^ (1 << draw.randrange(256)) for h in base]
    index = fingerprints.build(frame(spark, values), "k", "w", name(), buckets=8)
    row = fingerprints.candidates(index, spark).first()
    assert row["fingerprints"] == 6_000 and row["near"] >= 3_000 and row["candidates"] < 0.01 * row["pairs"]


def test_grid_words(spark):
    draw = random.Random(5)
    values = [draw.randint(0, 9) for _ in range(272)]
    bits = "".join("1" if values[r * 17 + c + 1] > values[r * 17 + c] else "0" for r in range(16) for c in range(16))
    row = spark.createDataFrame([(values,)], "v array<int>").select(fingerprints.grid_words(F.col("v"), 17, 16).alias("w")).first()["w"]
    assert "".join(f"{x & ((1 << 64) - 1):064b}" for x in row) == bits
