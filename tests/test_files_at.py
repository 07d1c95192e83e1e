"""Files opened by their paths: the rows of the scan, without the scan."""

import struct
import zlib

import numpy as np
import pytest

from tessera.plans import catalog
from tessera.sources import pixels, png


def made(depth, colour, data, *more):
    head = struct.pack(">IIBBBBB", 5, 4, depth, colour, 0, 0, 0)
    chunks = [(b"IHDR", head), *more, (b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in data)))]
    return png.SIGNATURE + b"".join(png._chunk(*c) for c in [*chunks, (b"IEND", b"")])


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "images/folder.png").mkdir(parents=True)
    (root / "masks").mkdir()
    rng = np.random.default_rng(3)
    drawn = lambda n: rng.integers(0, 256, (4, 5 * n), dtype=np.uint8)
    rgb = made(8, 2, drawn(3))
    images = {
        "gray": made(8, 0, drawn(1)), "rgb +ö": rgb, "alpha": made(8, 6, drawn(4)), "gray_alpha": made(8, 4, drawn(2)), "deep": made(16, 0, drawn(2)), "deep_rgb": made(16, 2, drawn(6)), "noted": made(8, 2, drawn(3), (b"tEXt", b"a\0b")),
        "palette": made(8, 3, drawn(1) % 3, (b"PLTE", bytes(range(9)))), "clear": made(8, 2, drawn(3), (b"tRNS", b"\0\1\0\2\0\3")), "gamma": made(8, 0, drawn(1), (b"gAMA", struct.pack(">I", 100_000))), "bits": made(1, 0, drawn(1)[:, :1]),
        "cut": rgb[:-30], "no_end": rgb[:-12], "changed": rgb[:60] + bytes([rgb[60] ^ 1]) + rgb[61:], "text": b"no image", "empty": b"", "signed": png.SIGNATURE, "longer": rgb + b"more",
    }
    for name, content in images.items():
        (root / f"images/{name}.png").write_bytes(content)
    for name, content in {"flat": png.encoded(np.array([[0, 255], [0, 255]], np.uint8)), "deep": png.encoded(np.array([[0, 300], [513, 0]], np.uint16)), "palette": images["palette"], "empty": b""}.items():
        (root / f"masks/{name}_mask.png").write_bytes(content)
    jvm = spark._jvm
    shown = jvm.java.awt.image.BufferedImage(20, 30, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for kind in ("jpg", "bmp", "gif"):
        assert jvm.javax.imageio.ImageIO.write(shown, kind, jvm.java.io.File(f"{root}/images/other_{kind}.{'png' if kind == 'gif' else kind}"))
    return root


def test_opened_files_have_the_rows_of_the_scan(spark, files):
    names = [f"file:{p}" for p in sorted(files.rglob("*.*")) if "rgb +" not in p.name or p.is_file()]
    asked = spark.createDataFrame([(n,) for n in [*names, names[1], None, f"file:{files}/images/none.png", f"file:{files}/none/x.png", "file:/elsewhere/x.png"]], "path string")
    scanned = sorted(pixels.facts(spark, str(files), 4, expected=asked).collect(), key=lambda r: r["path"])
    opened = pixels.facts_at(spark, str(files), asked, 4)
    assert sorted(opened.select(scanned[0].__fields__).collect(), key=lambda r: r["path"]) == scanned and len(scanned) == 25
    decoded = {r["path"].rpartition("/")[2] for r in scanned if r["width"]}
    assert {"gray.png", "rgb +ö.png", "other_jpg.jpg", "other_bmp.bmp", "palette.png", "deep_mask.png"} <= decoded and not {"text.png", "cut.png", "empty.png"} & decoded
    few = pixels.facts_at(spark, str(files), asked.where("path LIKE '%gray.png' OR path LIKE '%jpg'"), 4)
    assert few.count() == 2


def test_plain_files_and_bytes_that_are_no_image_need_no_scan(spark, files, monkeypatch):
    monkeypatch.setattr(pixels, "facts", None)
    asked = spark.createDataFrame([(f"file:{files}/{n}",) for n in ("images/gray.png", "images/text.png", "images/empty.png", "masks/deep_mask.png", "masks/none_mask.png")], "path string")
    assert pixels.facts_at(spark, str(files), asked).count() == 4


def test_stores_that_arrow_does_not_know_are_scanned(spark, files, monkeypatch):
    asked = spark.createDataFrame([(f"file:{files}/{n}",) for n in ("images/gray.png", "images/empty.png", "images/none.png")], "path string")
    monkeypatch.setattr(pixels, "_known_store", lambda root: False)
    assert {r["path"].rpartition("/")[2]: r["width"] for r in pixels.facts_at(spark, str(files), asked).collect()} == {"gray.png": 5, "empty.png": None}


def test_image_validation_lists_no_folder(spark, folder, monkeypatch):
    def listed(*_, **__):
        raise AssertionError("the folder of files is listed")

    monkeypatch.setattr(pixels, "facts", listed)
    found = catalog.queries()["image_validation_of_files"](spark, folder)
    assert found.count() == spark.read.parquet(f"{folder}/embeddings.parquet").count() and found.where("is_valid_mask").count() > 0


def test_image_copies_list_no_folder(spark, folder, monkeypatch):
    def listed(*_, **__):
        raise AssertionError("the folder of files is listed")

    monkeypatch.setattr(pixels, "facts", listed)
    found = catalog.queries()["image_copies_of_files"](spark, folder).collect()
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert sum(r["n"] for r in found) == n == sum(r[s] for r in found for s in ("train", "val", "test")) and all(r["representative"] % 4 == 0 for r in found)
