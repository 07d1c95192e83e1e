"""The audit and the preparation of a small synthetic tree, and the sources and sinks."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import images
from tessera.plans import flows
from tessera.sources import discovery, sinks
from tessera.streaming import audit_stream


def png(path, pixels):
    """A PNG file of gray (rows x columns) or RGB pixels."""
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "images").mkdir()
    (root / "masks").mkdir()
    rng = np.random.default_rng(0)
    yy, xx = np.mgrid[:128, :128]
    circle = ((yy - 64) ** 2 + (xx - 64) ** 2 <= 400).astype(np.uint8) * 255
    lines = ["image_path,mask_path,host,disease,split,mask_ratio"]
    for i in range(12):
        host, disease, split = ("Tomato", "Potato", "Apple")[i % 3], ("Early Blight", "Late Blight", "Healthy")[i % 3], ("train", "val", "test")[i % 3]
        png(root / f"images/img_{i:03d}.png", rng.integers(50, 200, (128, 128, 3), dtype=np.uint8))
        mask = circle if disease != "Healthy" else np.zeros_like(circle)
        png(root / f"masks/img_{i:03d}_mask.png", mask)
        lines.append(f"images/img_{i:03d}.png,masks/img_{i:03d}_mask.png,{host},{disease},{split},{(mask > 0).mean():.4f}")
    (root / "images/img_011.png").write_bytes((root / "images/img_000.png").read_bytes())
    (root / "metadata.csv").write_text("\n".join(lines) + "\n")
    (root / "README.md").write_text("about")
    return root


@pytest.fixture(scope="module")
def audited(spark, tree):
    return flows.audit(spark, str(tree))


def test_discovery_by_metadata(audited):
    found = audited.discovery
    assert found.structure == "metadata_driven" and found.records.count() == 12 and found.counts == {"image": 12, "mask": 12, "metadata": 1, "doc": 1}
    assert found.records.where("image_path IS NULL OR mask_path IS NULL").count() == 0


def test_validation(audited):
    c = audited.tables["validation_counters"].first()
    assert (c["valid_images"], c["valid_masks"], c["empty_masks"], c["ratio_discrepancies"]) == (12, 12, 4, 0)
    rows = audited.tables["validated"].where("disease <> 'Healthy'")
    assert {r["num_lesion_components"] for r in rows.collect()} == {1} and {r["mask_convention"] for r in rows.collect()} == {"binary_0_255"}


def test_duplicates_and_leakage(audited):
    pairs = audited.tables["duplicate_candidates"].collect()
    assert [(p["sample_id_1"], p["sample_id_2"], p["duplicate_type"], p["leakage_flag"]) for p in pairs] == [("img_000", "img_011", "exact_md5", True)]
    assert audited.tables["leakage"].first()["leakage_train_test"] == 1


def test_near_duplicates_are_confirmed_by_structure(spark, tmp_path):
    rng = np.random.default_rng(1)
    soft = np.kron(rng.integers(40, 200, (8, 8, 3)), np.ones((16, 16, 1))).astype(np.uint8)
    for name, pixels in (("a", soft), ("b", np.clip(soft.astype(int) + 2, 0, 255).astype(np.uint8)), ("c", 255 - soft)):
        png(tmp_path / f"{name}.png", pixels)
    found = flows.audit(spark, str(tmp_path))
    pairs = found.tables["duplicate_candidates"]
    assert [(r["sample_id_1"], r["sample_id_2"], r["duplicate_type"]) for r in pairs.collect()] == [("sample_000000", "sample_000001", "near_perceptual")]
    kept = flows.confirmed_edges(pairs, spark, str(tmp_path)).collect()
    assert len(kept) == 1 and kept[0]["ssim"] > 0.9 and flows.confirmed_edges(pairs, spark, str(tmp_path), similarity=1.01).count() == 0
    shade = np.clip(soft.astype(int) + 2, 0, 255).astype(np.uint8)
    assert kept[0]["ssim"] == pytest.approx(images.structural_similarity(soft[:, :, ::-1], shade[:, :, ::-1]), abs=1e-6)


def test_preparation_keeps_groups_together(spark, audited):
    classes = {"early blight": "Tomato — Early Blight", "late blight": "Potato — Late Blight"}
    found = flows.prepare(audited.tables["validated"], audited.tables["duplicate_candidates"], classes)
    manifest = found["manifest"].collect()
    assert len(manifest) == 10 and found["exclusions"].count() == 2  # two of four healthy records are within the ratio
    by_group = {}
    for r in manifest:
        by_group.setdefault(r["duplicate_group_id"], set()).add(r["benchmark_split"])
    assert all(len(s) == 1 for s in by_group.values())
    table, index = flows.classification_manifest(found["manifest"], 2)
    assert index == {"Potato — Late Blight": 0, "Tomato — Early Blight": 1} and {r["class_index"] for r in table.collect()} == {0, 1}
    assert flows.severity_manifest(found["manifest"]).count() == 10
    with pytest.raises(ValueError, match="expected"):
        flows.classification_manifest(found["manifest"], 10)


def test_discovery_by_layout(spark, tmp_path):
    pixel = np.zeros((40, 40), np.uint8)
    for part in ("train/Tomato___Early_Blight", "valid/apple_black_rot", "masks"):
        (tmp_path / part).mkdir(parents=True)
    png(tmp_path / "train/Tomato___Early_Blight/image_1.png", pixel)
    png(tmp_path / "valid/apple_black_rot/b.png", pixel)
    png(tmp_path / "masks/mask_1.png", pixel)
    found = discovery.discover(spark, str(tmp_path))
    rows = [(r["host"], r["disease"], r["split"], bool(r["mask_path"])) for r in found.records.orderBy("original_index").collect()]
    assert found.structure == "directory_hierarchy" and rows == [("Tomato", "Early Blight", "train", True), ("Apple", "Black rot", "val", False)]


def test_empty_and_missing(spark, tmp_path):
    assert discovery.discover(spark, str(tmp_path / "none")).structure == "missing_directory"
    (tmp_path / "x.bin").write_bytes(b"1")
    found = discovery.discover(spark, str(tmp_path))
    assert found.structure == "empty_or_unrecognized" and found.records.columns == discovery.standardize.RECORD.names


def test_json_and_separators(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"info": 1, "samples": [{"name": "x", "label": "y"}, {"name": "z"}]}))
    (tmp_path / "b.csv").write_text("name;label\nx;y\n")
    (tmp_path / "coco.json").write_text(json.dumps({"categories": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}], "annotations": [{"category_id": 1}, {"category_id": 1}]}))
    assert discovery.read_json(spark, str(tmp_path / "a.json")).count() == 2
    assert discovery.read_metadata(spark, str(tmp_path / "b.csv")).columns == ["name", "label", "__ordinal"]
    assert sorted(map(tuple, discovery.coco_categories(spark, str(tmp_path / "coco.json")).collect())) == [(1, "a", 2), (2, "b", 0)]


def test_manifest_sinks_and_settings(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_id,mask_area_ratio\na,0.5\nb,\n")
    rows = discovery.read_manifest(spark, str(tmp_path / "m.csv"), "image_id string, mask_area_ratio double")
    assert sorted(map(tuple, rows.collect()), key=str) == [("a", 0.5), ("b", None)]
    with pytest.raises(ValueError, match="lacks"):
        discovery.read_manifest(spark, str(tmp_path / "m.csv"), "other string")
    paths = sinks.write_report({"t": rows.withColumn("s", F.array("image_id"))}, str(tmp_path / "out"), "csv")
    assert spark.read.csv(paths[0], header=True).count() == 2
    sinks.write_predictions(rows.withColumns({"status": F.when(F.col("mask_area_ratio").isNull(), "error").otherwise("ok"), "error": F.lit(None).cast("string")}), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/predictions")).count() == 2 and spark.read.json(str(tmp_path / "p/results")).count() == 1
    assert discovery.setting(None, {"a": 2}, "a", 3) == 2 and discovery.setting(1, {"a": 2}, "a", 3) == 1 and discovery.setting(None, {}, "a", 3) == 3


def test_streams_give_the_batch_result(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    query = audit_stream.watch(spark, str(tmp_path / "in"), events.schema, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).groupBy("event_type").sum("count")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, events.groupBy("event_type").count().collect()))
    assert audit_stream.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_summaries_class_map_and_telemetry(spark, tmp_path):
    from tessera.functions import scalars
    from tessera.operators import inference, profile

    read = lambda name: json.loads("".join(p.read_text() for p in (tmp_path / name).glob("part-*")))
    rows = spark.createDataFrame([("b", "train", 1.0), ("a", "val", 3.0), (None, "test", None)], "label string, split string, v double")
    sinks.write_class_map(rows, "label", str(tmp_path))
    assert read("class_to_idx") == {"a": 0, "b": 1}
    sinks.write_summary(profile.manifest_summary(rows, "split", "label", F.col("label").isNull(), "v"), str(tmp_path), "summary")
    found = read("summary")
    assert (found["total"], found["diseased"], found["mean_value"], found["train_percent"], found["classes"]) == (3, 2, 2.0, 33.33, 2)
    paths = sinks.write_described(profile.describe_by(rows, "label", "v"), profile.describe_by(rows, "split", "v"), str(tmp_path / "d"))
    assert [spark.read.csv(p, header=True).count() for p in paths] == [2, 3]
    scored = spark.createDataFrame([("x.png", [0.7, 0.3], 10), ("y.png", None, None)], "image string, p array<double>, lesion long")
    results = inference.results(scored, "p", "lesion", ["a", "b"], 0.9).withColumn("error", F.when(F.col("status") == "error", "bad"))
    back = spark.read.csv(sinks.write_batch_predictions(results, str(tmp_path)), header=True)
    assert back.columns == sinks.PREDICTION_COLUMNS and sorted((r["image"], r["status"], r["predicted_class"]) for r in back.collect()) == [("x.png", "ok", "a"), ("y.png", "error", None)]
    frames = spark.createDataFrame([(100.0, 0.5, 1.0), (300.0, 0.7, 3.0)], "latency_ms double, confidence double, burden_percent double")
    sinks.write_telemetry(frames, inference.execution_statistics(frames), {"classifier": {"epoch": 3}}, str(tmp_path / "t"))
    found = read("t/inference_execution_summary")
    assert (found["frames"], found["frames_per_second"], found["latency_ms_median"], found["confidence_std"], found["burden_percent_mean"]) == (2, 5.0, 200.0, 0.1, 2.0)
    assert read("t/model_checkpoint_metadata") == {"classifier": {"epoch": 3}} and spark.read.csv(str(tmp_path / "t/per_sampled_frame_predictions"), header=True).count() == 2
    assert inference.execution_statistics(frames.limit(0)).first()["frames_per_second"] == 0
    named = spark.range(1).select(scalars.run_name("smoke_test_", F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("n"), scalars.now_iso().alias("t")).first()
    assert named["n"] == "smoke_test_20240102_030405" and len(named["t"]) == 26
