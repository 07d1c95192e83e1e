"""Facts taken at the scan: against NumPy on the same pixels, and without pixels in any shuffle."""

import struct
import zlib

import numpy as np
import pytest

from tessera.operators import images
from tessera.sources import pixels, png


def filtered(samples, kind, step):
    """PNG of byte rows written with one filter, to read back."""
    h, n = samples.shape
    out, above = [], np.zeros(n, int)
    for row in samples.astype(int):
        left = np.concatenate([np.zeros(step, int), row[:-step]])
        corner = np.concatenate([np.zeros(step, int), above[:-step]])
        p, q, r = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
        guess = [np.zeros(n, int), left, above, (left + above) // 2, np.where((p <= q) & (p <= r), left, np.where(q <= r, above, corner))][kind]
        out.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    return zlib.compress(b"".join(out))


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize(("depth", "colour", "channels"), [(8, 0, 1), (8, 2, 3), (8, 6, 4), (16, 0, 1), (16, 2, 3), (16, 4, 2)])
def test_png_filters(kind, depth, colour, channels):
    rng = np.random.default_rng(kind)
    stored = rng.integers(0, 256, (5, 7 * channels * depth // 8), dtype=np.uint8)
    head = struct.pack(">IIBBBBB", 7, 5, depth, colour, 0, 0, 0)
    content = png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", filtered(stored, kind, channels * depth // 8)) + png._chunk(b"IEND", b"")
    whole = (stored.view(">u2") if depth == 16 else stored).reshape(5, 7, channels)
    wanted = whole[:, :, 0] if channels < 3 else np.concatenate([whole[:, :, 2::-1], whole[:, :, 3:]], axis=2)
    assert np.array_equal(png.decoded(content), wanted)


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for pixels_ in (rng.integers(0, 256, (4, 6), dtype=np.uint8), rng.integers(0, 60_000, (3, 2), dtype=np.uint16)):
        assert np.array_equal(png.decoded(png.encoded(pixels_)), pixels_)
    good = png.encoded(np.zeros((4, 4), np.uint8))
    for bad in (b"", b"no image", good[:30], good[:-20], good.replace(b"IDAT", b"IDAX")):
        assert png.decoded(bad) is None


@pytest.fixture(scope="module")
def folder_of_images(tmp_path_factory):
    root = tmp_path_factory.mktemp("pixels")
    (root / "images").mkdir()
    (root / "masks").mkdir()
    rng = np.random.default_rng(2)
    shown = {f"i {k}+.png": rng.integers(0, 256, (40 + k, 50, 3), dtype=np.uint8) for k in range(4)}
    for name, p in shown.items():
        (root / "images" / name).write_bytes(png.encoded(p))
    masks = {"deep_mask.png": np.array([[0, 300, 0], [0, 0, 0], [513, 0, 0]], np.uint16), "flat_mask.png": np.array([[0, 255], [0, 255]], np.uint8)}
    for name, p in masks.items():
        (root / "masks" / name).write_bytes(png.encoded(p))
    (root / "images/broken.png").write_bytes(b"x")
    (root / "images/empty.png").write_bytes(b"")
    return root, shown, masks


def test_facts(spark, folder_of_images):
    root, shown, masks = folder_of_images
    expected = spark.createDataFrame([(f"file:{root}/images/{n}",) for n in ("empty.png", "none.png", "broken.png")] + [(None,)], "path string")
    found = {r["path"].rpartition("/")[2]: r for r in pixels.facts(spark, str(root), expected=expected).collect()}
    assert found.keys() == {*shown, *masks, "broken.png", "empty.png"}
    for name, p in shown.items():
        r = found[name]
        assert (r["kind"], r["width"], r["height"], r["channels"], r["words"]) == ("image", 50, p.shape[0], 3, images.difference_hash(p[:, :, ::-1]))
    assert [found["deep_mask.png"][c] for c in ("convention", "affected", "components")] == ["multivalue_max_513", 2, 2]
    assert [found["flat_mask.png"][c] for c in ("convention", "affected", "components")] == ["binary_0_255", 2, 1]
    assert (found["broken.png"]["width"], found["broken.png"]["length"], found["empty.png"]["length"]) == (None, 1, 0)


def test_no_pixels_are_shuffled(spark, folder_of_images):
    root = str(folder_of_images[0])
    paths = spark.createDataFrame([(f"file:{root}/images/i 1+.png",)], "path string")
    for df in (pixels.facts(spark, root), pixels.planes(spark, root, paths)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan or "MapInArrow".lower() in plan.lower()
        shuffled = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
        assert shuffled and not any("image#" in line or "data#" in line or "content#" in line for line in shuffled)


def test_planes(spark, folder_of_images, monkeypatch):
    root, shown, _ = folder_of_images
    names = ["i 0+.png", "i 3+.png"]
    paths = spark.createDataFrame([(f"file:{root}/images/{n}",) for n in [*names, names[0], "none.png"]], "path string")
    for most in (10, 0):  # candidates broadcast to the scan, or joined with the planes
        monkeypatch.setattr(pixels, "BROADCAST_PATHS", most)
        found = {r["path"].rpartition("/")[2]: np.frombuffer(r["plane"], np.float32) for r in pixels.planes(spark, str(root), paths).collect()}
        assert found.keys() == set(names)
        for n in names:
            assert np.allclose(found[n], images.similarity_plane(shown[n][:, :, ::-1]).ravel(), atol=1e-4)
