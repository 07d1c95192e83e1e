"""Known cases of the operators, and invariants over random inputs."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import components, duplicates, groups, images, metrics, profile, scoring, selection, splits, standardize, validate
from tessera.sources import pixels


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


# ---- metrics ----


def corner(side):
    m = np.zeros((100, 100), int)
    m[:side, :side] = 1
    return m.ravel().tolist()


@pytest.mark.parametrize(("truth", "predicted", "dice", "iou", "recall", "area"), [(corner(10), corner(10), 1, 1, 1, 0), (corner(0), corner(0), 1, 1, 1, 0), (corner(0), corner(5), 0, 0, 1, 25 / 10000), (corner(10), corner(10)[::-1], 0, 0, 0, 100 / 10000)])
def test_mask_metrics_known_cases(spark, truth, predicted, dice, iou, recall, area):
    counts = spark.createDataFrame([(truth, predicted)], "t array<int>, p array<int>").select(metrics.overlap(F.col("t"), F.col("p")).alias("o")).select("o.*")
    r = counts.select(*(c.alias(n) for n, c in metrics.mask_metrics(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))).items())).first()
    assert (r["dice"], r["iou"], r["recall"], r["false_positive_area_ratio"]) == pytest.approx((dice, iou, recall, area), abs=1e-6)


def test_regression_with_constant_truth(spark):
    r = metrics.regression_metrics(spark.createDataFrame([(0.1, 0.1), (0.1, 0.2), (0.1, 0.3)], "t double, p double"), "t", "p").first()
    assert r["mae"] == pytest.approx(0.1) and r["r2"] is None and r["pearson"] is None


def test_lower_and_midpoint_median(spark):
    r = metrics.regression_metrics(spark.createDataFrame([(0.0, x) for x in (1.0, 2.0, 3.0, 10.0)], "t double, p double"), "t", "p").first()
    assert (r["median_ae"], r["median_ae_lower"]) == (2.5, 2.0)


def test_spearman_with_ties(spark):
    import pandas as pd

    x = [(float(random.Random(i).randrange(6)), float(random.Random(i + 99).randrange(6))) for i in range(60)]
    frame = pd.DataFrame(x, columns=["t", "p"])
    found = metrics.spearman(spark.createDataFrame(x, "t double, p double"), "t", "p").first()[0]
    assert found == pytest.approx(frame["t"].rank().corr(frame["p"].rank()))


def test_top_two_margin_entropy(spark):
    p = [0.0125] * 10
    p[3], p[7] = 0.7, 0.2
    r = one(spark, top=S.top_k(F.array(*map(F.lit, p)), 2), flat=S.normalised_entropy(F.array(*[F.lit(0.1)] * 10)), sure=S.normalised_entropy(F.array(F.lit(1.0), *[F.lit(0.0)] * 9)), single=S.normalised_entropy(F.array(F.lit(1.0))))
    assert [x["index"] for x in r["top"]] == [3, 7] and r["top"][0]["value"] - r["top"][1]["value"] == pytest.approx(0.5)
    assert (r["flat"], r["sure"], r["single"]) == pytest.approx((1, 0, 0), abs=1e-6)


def test_confusion_is_dense(spark):
    rows = metrics.confusion(spark.createDataFrame([("a", "b"), ("a", "a"), ("x", "a")], "t string, p string"), "t", "p", ["a", "b"])
    assert {(r["truth"], r["predicted"]): r["n"] for r in rows.collect()} == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 0}


def test_empty_mask_summary(spark):
    empty = spark.createDataFrame([], "dice double, iou double, precision double, recall double, pixel_accuracy double, false_positive_area_ratio double, pred_lesion_ratio double, is_healthy boolean")
    r = metrics.mask_summary(empty).first()
    assert r["mean_dice"] == 0 and r["perfect_clean_rate"] == 1 and r["total_samples"] == 0


# ---- duplicates, groups, splits ----


def test_pair_counts_equal_pairs(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, rng.choice("abcdef") if i % 9 else None, rng.choice(["train", "VAL", "validation", "test", "unassigned"])) for i in range(80)], "o long, d string, s string")
    fast = duplicates.pair_counts(rows, "d", "s").first()
    pairs = duplicates.exact_pairs(rows, "o", "d", ["s"]).withColumns({c: F.when(F.lower(c) == "validation", "val").otherwise(F.col(c)) for c in ("s_1", "s_2")})
    slow = duplicates.leak_counts(pairs, "s_1", "s_2").first()
    assert tuple(fast) == tuple(slow)


@pytest.mark.parametrize("threshold", [2, 6])
def test_chunked_search_is_exact_and_bucketed_is_a_subset(spark, threshold):
    rng = random.Random(threshold)
    base = [[rng.getrandbits(63) for _ in range(4)] for _ in range(12)]
    rows = [(i, [w ^ (1 << rng.randrange(62)) if rng.random() < 0.3 else w for w in base[i % 12]]) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, None)], "o long, w array<long>")
    near = lambda mode: {tuple(r) for r in duplicates.near_pairs(df, "o", "w", threshold, [64] * 4, mode).collect()}
    exact = near("exact")
    assert exact == near("exhaustive") and near("bucketed") <= exact and exact


def test_union_find_cases(spark):
    ids = spark.createDataFrame([(f"img_{i}",) for i in range(1, 5)], "id string")
    edges = spark.createDataFrame([("img_1", "img_2"), ("img_2", "img_3"), ("img_3", "gone")], "a string, b string")
    found = {r["id"]: r["duplicate_group_id"] for r in groups.group_ids(ids, "id", edges, "a", "b").collect()}
    assert found == {"img_1": "grp_00001", "img_2": "grp_00001", "img_3": "grp_00001", "img_4": "grp_00002"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_match_a_plain_search(spark, pairs):
    parent = {x: x for p in pairs for x in p if p[0] != p[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = components.components(spark.createDataFrame(pairs, "u long, v long"))
    assert sorted(map(tuple, found.collect())) == sorted((x, root(x)) for x in parent)


def test_zero_leakage(spark):
    good = spark.createDataFrame([("1", "train"), ("1", "train"), ("2", "val"), ("3", "test")], "g string, s string")
    assert groups.assert_no_leakage(good, "g", "s") is good
    with pytest.raises(ValueError, match="1"):
        groups.assert_no_leakage(good.union(spark.createDataFrame([("1", "val")], good.schema)), "g", "s")


def test_greedy_split_is_the_plain_fold(spark):
    rng = random.Random(1)
    sizes = [(f"g{i:03d}", rng.randrange(1, 6), rng.choice("abc")) for i in range(70)]
    found = {r[0]: r[1] for r in splits.greedy_splits(spark.createDataFrame(sizes, "g string, n long, s string"), "g", "n", "s").collect()}
    import hashlib

    wanted = splits.targets(sum(n for _, n, _ in sizes), 0.7, 0.15)
    have = dict.fromkeys(S.SPLITS, 0)
    for g, n, _ in sorted(sizes, key=lambda x: (x[2], hashlib.md5(f"{x[0]}:42".encode()).hexdigest())):
        best = max(S.SPLITS, key=lambda s: (wanted[s] - have[s]) / max(1, wanted[s]))
        have[best] += n
        assert found[g] == best


def test_targets_round_half_to_even():
    assert splits.targets(10, 0.25, 0.25) == {"train": 2, "val": 2, "test": 6}
    assert splits.healthy_allowed(10, 0.2, 99) == 2 and splits.healthy_allowed(10, 1.0, 99) == 99


# ---- profiles and selections ----


def test_profile_of_one_value_and_of_none(spark):
    r = profile.profile(spark.createDataFrame([(1.0, None)], "a double, b double"), {"a": F.col("a"), "b": F.col("b")}).collect()
    assert (r[0]["std"], r[0]["n"]) == (0, 1) and (r[1]["std"], r[1]["n"], r[1]["mean"]) == (None, 0, None)


def test_histogram_keeps_the_maximum(spark):
    assert {r["bin"]: r["n"] for r in profile.histogram(spark.createDataFrame([(float(x),) for x in range(11)], "v double"), "v", 5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert [tuple(r)[:2] for r in profile.histogram(spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double"), "v", 5).collect()] == [(0, 2)]


def test_positions_are_a_total_order(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 11) for i in range(100)], "k long, v long")
    found = selection.numbered(rows, [F.desc("v"), F.asc("k")]).orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(100))
    assert [(r["v"], r["k"]) for r in found] == sorted(((v, k) for k, v in rows.collect()), key=lambda x: (-x[0], x[1]))


def test_running_best(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.1, 0.3, 0.2, 0.2, 0.4])], "g int, e int, v double")
    found = selection.running_best(rows, "g", ["e"], "v", 2).orderBy("e").collect()
    assert [r["best"] for r in found] == [0.1, 0.3, 0.3, 0.3, 0.4] and [r["waited"] for r in found] == [0, 0, 1, 2, 0] and [r["stopped"] for r in found] == [False, False, False, True, True]


# ---- scalars, standardising, scoring ----


def test_paths_splits_and_clipping(spark):
    r = one(
        spark, a=S.relative_to_first_marker(F.lit(r"c:\x\images\a\images\b.png")), b=S.relative_to_last_marker(F.lit("x/images/a/images/b.png")), c=S.relative_to_last_marker(F.lit(None).cast("string")), d=S.clipped(F.lit(None).cast("double")), e=S.clipped(F.lit(1.5)),
        f=S.split_normalised(F.lit("Invalid")), g=S.split_normalised(F.lit(None).cast("string")), h=S.stem(F.lit("/a/b.c.png")), i=S.capitalised(F.lit("eARLY Blight")), j=S.stem(F.lit("/a/.png")),
    )
    assert tuple(r) == ("images/a/images/b.png", "images/b.png", "", None, 1.0, "val", "unassigned", "b.c", "Early blight", ".png")
    with pytest.raises(Exception, match="no marker"):
        one(spark, a=S.relative_to_first_marker(F.lit("nowhere/b.png")))


def test_synonyms_prefer_the_first():
    found = standardize.resolved(["Image-Path", "name", "Label", "label file", "W"])
    assert found == {"image": "name", "mask": "label file", "disease": "Label", "width": "W"}


def test_scoring_isolates_errors(spark):
    rows = spark.createDataFrame([(1, "2"), (2, "x"), (3, None)], "k int, v string")
    found = {r["k"]: (r["result"], r["status"]) for r in scoring.scored(rows, "v", lambda: int, "int").collect()}
    assert found == {1: (2, "ok"), 2: (None, "error"), 3: (None, "error")}
    assert scoring.class_map_errors({"a": 0, "b": 1}, 2) == [] and len(scoring.class_map_errors({"a": 0, "b": 0}, 3)) == 2


def test_nested_results(spark):
    import json

    from tessera.operators import inference

    rows = spark.createDataFrame([("a.png", [0.7, 0.2, 0.1], 131072, 0.25), ("b.png", [0.4, 0.35, 0.25], 0, None)], "image string, p array<double>, px long, direct double")
    found = inference.results(rows, "p", "px", ["x", "y", "z"], 0.5)
    made = {r[0]: json.loads(r[1]) for r in found.select("image", inference.nested("image", regression=F.col("direct"), classes=["x", "y", "z"])).collect()}
    a, b = made["a.png"], made["b.png"]
    assert a["segmentation"]["image_relative_lesion_burden"] == 0.5 and a["segmentation"]["burden_percent"] == 50 and a["direct_regression"]["absolute_disagreement"] == 0.25
    assert "direct_regression" not in b and b["system"]["input_within_supported_scope"] is None and len(b["system"]["warnings"]) == 1 and a["classification"]["top2"][1]["class_index"] == 1


def test_out_of_shape(spark):
    rows = spark.createDataFrame([(600, 100), (100, 20), (100, 100), (0, 5), (None, 5)], "w int, h int")
    assert [r[0] for r in rows.select(validate.unusual(F.col("w"), F.col("h"))).collect()] == [validate.EXTREME_ASPECT, validate.VERY_SMALL, None, validate.EXTREME_ASPECT, None]


# ---- pixels ----


def test_components_of_pixels():
    m = np.zeros((6, 6), bool)
    m[0, 0] = m[1, 1] = m[4, 4] = m[4, 0] = True
    assert images.count_components(m) == 3 and images.count_components(np.zeros((3, 3), bool)) == 0
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    assert images.count_components(ring) == 1


def test_similarity_and_hash():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (64, 64, 3), dtype=np.uint8)
    assert images.structural_similarity(a, a) == pytest.approx(1) and images.structural_similarity(a, None) == 0
    assert images.difference_hash(a) == images.difference_hash(a.copy()) and len(images.difference_hash(a)) == 4
    assert images.crop_box(np.zeros((4, 4))) is None and images.padded_to_square(a[:, :61]).shape == (64, 64, 3)


def test_mask_channels():
    four = np.zeros((2, 2, 4), np.uint8)
    four[..., 2] = 255
    assert images.mask_plane(four).max() == 0
    assert pixels.mask_summary(np.array([[0, 255], [0, 0]], np.uint8)) == ("binary_0_255", 1, 1) and pixels.mask_summary(np.zeros((2, 2), np.uint8)) == ("binary_0_1", 0, 0)
    assert pixels.mask_summary(np.array([[0, 300]], np.uint16)) == ("multivalue_max_300", 1, 1)


def test_entropy_bounds(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(20):
        x = [rng.random() for _ in range(10)]
        rows.append(([v / sum(x) for v in x],))
    assert all(0 <= r[0] <= 1 + 1e-9 and not math.isnan(r[0]) for r in spark.createDataFrame(rows, "p array<double>").select(S.normalised_entropy(F.col("p"))).collect())
