"""Model inputs: normalising, its inverse, and scoring by batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import images, scoring, tensors
from tessera.sources import pixels, png


def test_normalising_and_back():
    rng = np.random.default_rng(0)
    flat = rng.integers(0, 256, (4, 3 * 25)).astype(float)
    there = tensors.normalised(flat)
    assert there.dtype == np.float32 and np.abs(tensors.restored(there) - flat).max() < 255 * 1e-6
    red = (flat[0, 3] / 255 - 0.485) / 0.229
    assert there[0, 3] == pytest.approx(red, abs=1e-6) and there[0, 74] == pytest.approx((flat[0, 74] / 255 - 0.406) / 0.225, abs=1e-6)


@pytest.mark.parametrize("shape", [tensors.Shape(16, True), tensors.Shape(16)])
def test_shapes(shape):
    rng = np.random.default_rng(1)
    wide = rng.integers(0, 256, (10, 20, 3), dtype=np.uint8)
    found = tensors.pixels_of(wide, shape)
    square = np.stack([images.padded_to_square(wide[:, :, k]) if shape.padded else wide[:, :, k] for k in (2, 1, 0)])
    assert found.shape == (3, 16, 16)
    assert np.array_equal(found, np.clip(np.rint([images.resized(p.astype(float), 16, 16) for p in square]), 0, 255))
    assert np.array_equal(tensors.pixels_of(wide[:, :, 0], shape)[0], tensors.pixels_of(np.stack([wide[:, :, 0]] * 3, 2), shape)[2])


def test_files_are_scored_by_batches(spark, tmp_path):
    """Tensors of files through a vectorised model: mean of the restored red plane."""
    rng = np.random.default_rng(2)
    given = {f"i{k}.png": rng.integers(0, 256, (8, 8, 3), dtype=np.uint8) for k in range(5)}
    for name, p in given.items():
        (tmp_path / name).write_bytes(png.encoded(p))
    (tmp_path / "broken.png").write_bytes(b"x")
    rows = pixels.tensor_rows(spark, str(tmp_path), tensors.Shape(8))

    def load():
        return lambda batch: tensors.restored(batch.reshape(len(batch), -1))[:, :64].mean(1)

    scored = rows.withColumn("red", scoring.batch_scored(rows, ["tensor"], load, "double", 2, [[3, 8, 8]])).withColumn("back", tensors.restored_pixels(F.col("tensor")))
    found = {r["key"].rpartition("/")[2]: r for r in scored.collect()}
    assert found.keys() == set(given)
    for name, p in given.items():
        assert found[name]["red"] == pytest.approx(p[:, :, 0].mean(), abs=1e-4)
        assert found[name]["back"] == p.transpose(2, 0, 1).ravel().tolist()
