"""The audit and the preparation of a dataset end to end: each stage is a DataFrame that the next one reads."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import classes, duplicates, fingerprints, groups, images, profile, splits, validate
from tessera.sources import discovery, pixels
from tessera.tables import written

# Classes of the published benchmark by disease name, and limits of near duplicates.
BENCHMARK_CLASSES = {
    "tomato early blight": "Tomato — Early Blight", "potato late blight": "Potato — Late Blight", "apple black rot": "Apple — Black Rot", "grape downy mildew": "Grape — Downy Mildew", "corn gray leaf spot": "Corn — Gray Leaf Spot",
    "soybean frog eye leaf spot": "Soybean — Frogeye Leaf Spot", "bell pepper bacterial spot": "Bell Pepper — Bacterial Spot", "wheat leaf rust": "Wheat — Leaf Rust", "banana black leaf streak": "Banana — Black Sigatoka", "citrus canker": "Citrus — Citrus Canker",
}
HASH_SIDE, HASH_BITS, HASH_THRESHOLD, SIMILARITY = 16, [64, 64, 64, 64], 6, 0.85
TIERS = (("Strong", 100, 80), ("Usable", 40, 30), ("Limited", 15, 10))


@dataclass
class Audit:
    discovery: discovery.Discovery
    tables: dict[str, DataFrame]


@dataclass
class Copies:
    """The duplicate audit's own tables: ``classes`` of equal files, ``membership`` of every valid record, ``edges`` and ``counters``.

    ``edges`` has a star for each class and one edge for each pair of classes that look alike, between representatives;
    they connect what all pairs would connect. ``counters`` count all pairs, by arithmetic.
    """

    classes: DataFrame
    membership: DataFrame
    edges: DataFrame
    counters: DataFrame


CARRIED = ["sample_id", "image_path", "split", "host", "disease"]


def copies_of(records: DataFrame, facts: DataFrame, near: bool = True, mode: str = "exact", threshold: int = HASH_THRESHOLD) -> Copies:
    """Duplicates of valid images: equal bytes, and near difference hashes of different bytes.

    ``mode`` exact keeps an index of hash blocks; ``exhaustive`` and ``bucketed`` are those of ``duplicates.near_pairs``.
    """
    key = "original_index"
    digests = facts.select(F.col("path").alias("image_path"), "digest", "words")
    rows = written(records.where("is_valid_image").select(key, *CARRIED).join(digests, "image_path"), "valid-images")
    found, members = classes.audited(rows, key, "digest", "split", CARRIED)
    columns = [f"{c}_{k}" for c in [key, *CARRIED] for k in (1, 2)]
    stars = classes.star_edges(members, found, key, CARRIED).withColumns({"similarity_metric": F.lit("byte_exact"), "metric_value": F.lit(0.0)})
    edges, counters = stars, classes.exact_counters(found)
    if near:
        hashed = rows.join(found.select(F.col("representative").alias("__r")), F.col(key) == F.col("__r"), "left_semi").select(key, "words")
        if mode == "exact":
            index = fingerprints.build(hashed, key, "words", f"image_hashes_{uuid.uuid4().hex}", fingerprints.Scheme(sum(HASH_BITS), threshold))
            pairs = fingerprints.near_pairs(index, records.sparkSession).withColumnsRenamed({"id_1": "representative_1", "id_2": "representative_2"})
        else:
            pairs = duplicates.near_pairs(hashed, key, "words", threshold, HASH_BITS, mode, 4, 100).withColumnsRenamed({f"{key}_{k}": f"representative_{k}" for k in (1, 2)})
        alike = classes.near_class_pairs(written(pairs, "near"), found, CARRIED)
        counters = classes.pair_counters(counters, classes.near_counters(alike))
        alike = alike.withColumnsRenamed({f"representative_{k}": f"{key}_{k}" for k in (1, 2)}).withColumns({"duplicate_type": F.lit(duplicates.NEAR), "similarity_metric": F.lit("hamming_distance"), "metric_value": F.col("distance").cast("double")})
        edges = edges.select(*columns, "duplicate_type", "similarity_metric", "metric_value").unionByName(alike.select(*columns, "duplicate_type", "similarity_metric", "metric_value"))
    return Copies(found, members, edges.withColumn("leakage_flag", duplicates.leaks(F.col("split_1"), F.col("split_2"))), counters)


def confirmed_edges(edges: DataFrame, spark: SparkSession, root: str, threshold: int = HASH_THRESHOLD, similarity: float = SIMILARITY) -> DataFrame:
    """Exact edges, and near ones whose images are structurally similar.

    Every candidate image is decoded once, to a plane; the planes are written and joined to the candidate pairs.
    """
    near = edges.where(F.col("duplicate_type") == duplicates.NEAR).where(F.col("metric_value") <= threshold)
    ends = near.select(F.explode(F.array("image_path_1", "image_path_2")).alias("path"))
    planes = written(pixels.planes(spark, root, ends), "planes")
    side = lambda k: planes.select(F.col("path").alias(f"image_path_{k}"), F.col("plane").alias(f"__plane_{k}"))
    scored = near.join(side(1), "image_path_1", "left").join(side(2), "image_path_2", "left").withColumn("ssim", images.plane_similarity(F.col("__plane_1"), F.col("__plane_2")))
    exact = edges.where(F.col("duplicate_type") == duplicates.EXACT).withColumn("ssim", F.lit(None).cast("double"))
    return duplicates.confirmed(exact.unionByName(scored.select(exact.columns)), threshold, similarity)


def audit(spark: SparkSession, root: str, near: bool = True, limit: int | None = None) -> Audit:
    """Discovery, validation, duplicates, profiles and tiers of the dataset below ``root``. An empty dataset has no tables."""
    found = discovery.discover(spark, root)
    if found.records.isEmpty():
        return Audit(found, {})
    facts = written(pixels.facts(spark, root, HASH_SIDE), "facts")
    rows = written(validate.validated(found.records, facts, limit=limit), "validated")
    conditional = profile.conditional_profile(rows, ["host", "disease"], F.col("is_valid_image"), F.col("is_valid_mask"), "affected_area_ratio", "split", S.SPLITS)
    copies = copies_of(rows, facts, near)
    edges = written(copies.edges, "edges")
    valid = rows.where("is_valid_image")
    measured = {
        "width": F.col("width"), "height": F.col("height"), "aspect": profile.aspect(F.col("width"), F.col("height")),
        "mask_ratio": F.when(F.col("is_valid_mask"), F.col("affected_area_ratio")), "components": F.when(F.col("is_valid_mask"), F.col("num_lesion_components")),
    }
    tables = {"validated": rows, "validation_errors": validate.errors(rows), "validation_counters": validate.counters(rows)}
    tables |= {"duplicate_classes": copies.classes, "duplicate_membership": copies.membership, "duplicate_candidates": edges, "leakage": copies.counters}
    tables |= {f"{c}_distribution": profile.value_counts(rows, c) for c in ("host", "disease", "split")}
    tables |= {"host_x_disease": profile.cross_table(rows, "host", "disease"), "disease_x_split": profile.cross_table(rows, "disease", "split")}
    tables |= {"channels": profile.present_counts(valid, "channels"), "conventions": profile.present_counts(rows, "mask_convention"), "profiles": profile.profile(valid, measured)}
    tables |= {"top_resolutions": profile.top_values(valid, F.concat_ws("x", "width", "height"), 10), "class_profile": conditional, "class_feasibility": profile.feasibility(conditional, TIERS)}
    return Audit(found, tables)


def prepare(rows: DataFrame, edges: DataFrame, display: dict[str, str] = BENCHMARK_CLASSES, healthy_ratio: float = 0.2, train: float = 0.7, val: float = 0.15, seed: int = 42, strict_healthy: bool = False) -> dict[str, DataFrame]:
    """Manifest and exclusions of validated records and confirmed duplicate edges (sample_id_1, sample_id_2).

    Records of one duplicate group share a split, which is checked. ``strict_healthy`` calls only
    named healthy records healthy; by default a record without affected pixels is, as in the reference.
    """
    named = F.lower(F.trim("disease")).contains("healthy")
    healthy = F.col("is_valid_image") & (named if strict_healthy else S.healthy_record(F.col("disease"), F.col("affected_pixels")))
    reason = splits.exclusion_reason(F.col("is_valid_image"), F.col("image_error"), F.col("disease"), healthy, list(display), True, F.col("is_valid_mask"), F.col("mask_error"), F.col("affected_pixels"))
    judged = written(rows.withColumns({"is_healthy": healthy, "reason": reason}), "judged")
    kept = splits.healthy_cap(judged.where("reason IS NULL"), "sample_id", "is_healthy", healthy_ratio, seed)
    capped = F.lit(f"Healthy sample capped by max_ratio ({healthy_ratio:.2f}) threshold")
    log = lambda df, why: df.select(F.col("sample_id").alias("image_id"), F.col("image_path").alias("original_path"), why.alias("reason"), *([F.col("source")] if "source" in df.columns else []), F.col("split").alias("original_split"))
    exclusions = log(judged.where("reason IS NOT NULL"), F.col("reason")).unionByName(log(kept.where("capped"), capped))
    names = F.create_map(*(F.lit(x) for pair in display.items() for x in pair))
    active = written(kept.where("NOT capped").withColumn("display_class", F.when(F.col("is_healthy"), F.concat("host", F.lit(" — Healthy"))).otherwise(F.try_element_at(names, F.lower(F.trim("disease"))))), "active")
    active = active.join(groups.group_ids(active, "sample_id", edges, "sample_id_1", "sample_id_2"), "sample_id")
    by_group = groups.group_profile(active, "duplicate_group_id", "disease", "host", F.col("is_healthy"))
    chosen = splits.greedy_splits(by_group.withColumn("stratum", splits.stratum(F.col("host"), F.col("disease"), F.col("is_healthy"))), "duplicate_group_id", "n", "stratum", train, val, seed)
    active = written(splits.assigned(active, written(chosen, "splits"), "duplicate_group_id"), "assigned")
    groups.assert_no_leakage(active, "duplicate_group_id", "benchmark_split")
    manifest = active.select(
        F.col("sample_id").alias("image_id"), "image_path", "mask_path", "host", "disease", "display_class", F.col("split").alias("original_split"), "benchmark_split", F.col("benchmark_split").alias("phase2_split"), "duplicate_group_id", "is_healthy",
        F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.col("affected_pixels").alias("mask_pixels"), F.col("affected_area_ratio").alias("mask_area_ratio"))
    return {"manifest": manifest, "exclusions": exclusions, "class_distribution": profile.pivot_counts(manifest, "display_class", "benchmark_split", list(S.SPLITS)), "group_report": groups.group_report(active, "duplicate_group_id", "split")}


def classification_manifest(manifest: DataFrame, n_classes: int = 10) -> tuple[DataFrame, dict[str, int]]:
    """Diseased records with class indices by sorted name; raises unless there are exactly ``n_classes`` classes."""
    diseased = manifest.where("NOT is_healthy")
    names = sorted(r[0] for r in diseased.select("display_class").distinct().limit(n_classes + 1).collect())
    if len(names) != n_classes:
        raise ValueError(f"{len(names)} classes, {n_classes} expected")
    index = {n: i for i, n in enumerate(names)}
    mapped = F.create_map(*(F.lit(x) for pair in index.items() for x in pair))
    return diseased.select(
        "image_id", S.relative_to_first_marker(F.col("image_path")).alias("image_relpath"), S.relative_to_last_marker(F.col("mask_path"), "annotations/").alias("mask_relpath"), "host", "disease", "display_class",
        F.element_at(mapped, F.col("display_class")).alias("class_index"), "original_split", "benchmark_split", "duplicate_group_id", "mask_area_ratio"), index


def severity_manifest(manifest: DataFrame) -> DataFrame:
    """All records with their target ratio; raises if one lies outside [0, 1]."""
    bad = manifest.where(~F.col("mask_area_ratio").between(0, 1)).count()
    if bad:
        raise ValueError(f"{bad} ratios outside [0, 1]")
    return manifest.select(
        "image_id", S.relative_to_last_marker(F.col("image_path")).alias("image_relpath"), S.relative_to_last_marker(F.col("mask_path"), "annotations/").alias("mask_relpath"), "host", "disease", "display_class", "original_split", "benchmark_split", "duplicate_group_id", "mask_area_ratio", "is_healthy")
