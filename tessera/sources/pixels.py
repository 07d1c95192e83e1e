"""Facts about image files, taken where the files are read: pixels never leave the task that decodes them.

Spark's reader decodes, an Arrow function in the same stage reduces each image to a narrow row, and only such rows are
shuffled. Digests and lengths come from a scan of the bytes, whose contents stay in that stage too. Where the paths are
known, tasks open the files themselves, once: the driver lists no folder, and its work doesn't grow with the files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import images, tensors
from tessera.sources import discovery, png
from tessera.tables import bounded_batches, dealt, written

#: What an image or mask is reduced to: difference hash of images; convention, affected pixels and regions of masks.
FACTS = "key string, width int, height int, channels int, words array<bigint>, convention string, affected long, components int"
#: Candidate paths are broadcast to the scan up to this number; beyond it all images are reduced to planes, and the planes are joined.
BROADCAST_PATHS = 200_000
PLANE = "key string, plane binary"
#: Files that a task opens, about.
FILES_EACH = 4096
#: First bytes of the formats that Spark's reader may know; files that begin otherwise don't decode.
STARTS = (png.SIGNATURE, b"\xff\xd8", b"GIF8", b"BM", b"II", b"MM", b"RIFF", b"\0")


def file_key(path: Column) -> Column:
    """A path as both scans write it: decoded, with one slash behind the scheme."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def mask_summary(mask: np.ndarray, components: bool = True) -> tuple[str, int, int]:
    """Convention, affected pixels (above 0) and their 8-connected regions (0 where not asked for)."""
    plane = images.mask_plane(mask)
    most = int(plane.max())
    values = set(np.unique(plane).tolist())
    affected = plane > 0
    n = int(affected.sum())
    return images.convention(values, most), n, images.count_components(affected) if components and n else 0


def _facts(key: str, is_mask: bool, pixels: np.ndarray, side: int, components: bool) -> tuple:
    h, w = pixels.shape[:2]
    found = mask_summary(pixels, components) if is_mask else (None, None, None)
    return key, w, h, 1 if pixels.ndim == 2 else pixels.shape[2], None if is_mask else images.difference_hash(pixels, side), *found


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()), "binary": pa.binary()}
    return [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _reduced(rows: DataFrame, pixels_of: Callable[[dict], np.ndarray | None], each: Callable[[dict, np.ndarray], tuple], schema: str) -> DataFrame:
    """``each`` of the decoded pixels of every row, by Arrow batches in the stage that reads them; rows that don't decode are left out."""
    fields = _fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                if (pixels := pixels_of(row)) is not None and pixels.size:
                    out.append(each(row, pixels))
            yield _batch(out, fields)

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _of_struct(row: dict) -> np.ndarray | None:
    w, h, c = (row[x].as_py() for x in ("width", "height", "nChannels"))
    if not w or w < 0 or not row["data"].is_valid:
        return None
    pixels = np.frombuffer(row["data"].as_buffer(), np.uint8).reshape(h, w, c)
    return pixels[:, :, 0] if c == 1 else pixels


def _images(spark: SparkSession, root: str) -> DataFrame:
    """key and decoded fields of every file that Spark's reader decodes."""
    read = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root)
    return read.select(file_key(F.col("image.origin")).alias("key"), "image.width", "image.height", "image.nChannels", "image.data")


def _is_mask(spark: SparkSession, root: str) -> Column:
    return discovery.file_class(F.col("key"), discovery.qualified(spark, root)) == "mask"


def empty_files(paths: DataFrame) -> DataFrame:
    """Those of ``paths`` (path) that are files without bytes, which Spark's readers don't list. Stores that Arrow doesn't know have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    store, at = fs.FileSystem.from_uri(path)
                    info = store.get_file_info(at)
                except (ValueError, OSError):
                    continue
                if info.type == fs.FileType.File and info.size == 0:
                    found.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    bounded_batches(paths.sparkSession)
    return paths.mapInArrow(run, "path string")


def facts(spark: SparkSession, root: str, side: int = 16, components: bool = True, expected: DataFrame | None = None) -> DataFrame:
    """path, kind, length, digest (MD5) of every image and mask below ``root``, and its FACTS, null where it doesn't decode.

    The files are read twice, for bytes and for pixels; masks of 16 bits a sample are decoded from the bytes, unchanged.
    ``expected`` paths (path) that the scan doesn't find are looked up one by one, which tells empty files from missing ones.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    files = files.withColumn("kind", discovery.file_class(F.col("path"), discovery.qualified(spark, root))).where("kind IN ('image', 'mask')")
    narrow = files.select("path", "kind", "length", F.md5("content").alias("digest"), file_key(F.col("path")).alias("__key"))
    as_facts = lambda row, pixels: _facts(row["key"].as_py(), bool(row["is_mask"].as_py()), pixels, side, components)
    shallow = _reduced(_images(spark, root).withColumn("is_mask", _is_mask(spark, root)), _of_struct, as_facts, FACTS)
    signed = (F.substring("content", 1, 8) == F.lit(png.SIGNATURE)) & (F.substring("content", 25, 1) == F.lit(b"\x10"))
    deep = files.where((F.col("kind") == "mask") & signed).select(file_key(F.col("path")).alias("key"), "content", F.lit(True).alias("is_mask"))
    deep = _reduced(deep, lambda row: png.decoded(row["content"].as_py()), as_facts, FACTS)
    chosen = shallow.withColumn("__rank", F.lit(1)).unionByName(deep.withColumn("__rank", F.lit(0))).groupBy("key").agg(F.min_by(F.struct(*(c.split()[0] for c in FACTS.split(", "))), "__rank").alias("f"))
    found = narrow.join(chosen, F.col("__key") == F.col("key"), "left").select("path", "kind", "length", "digest", "f.*").drop("key")
    if expected is None:
        return found
    blank = empty_files(expected.where("path IS NOT NULL").select("path").distinct().join(narrow.select("path"), "path", "left_anti"))
    kind = discovery.file_class(F.col("path"), discovery.qualified(spark, root))
    return found.unionByName(blank.select("path", kind.alias("kind"), F.lit(0).cast("long").alias("length"), F.md5(F.lit(b"")).alias("digest")), allowMissingColumns=True)


def _known_store(root: str) -> bool:
    try:
        fs.FileSystem.from_uri(root)
    except (ValueError, OSError):
        return False
    return True


def facts_at(spark: SparkSession, root: str, paths: DataFrame, side: int = 16, components: bool = True) -> DataFrame:
    """The rows of ``facts`` of those among ``paths`` (path, as the scan writes it) that are files below ``root``, written. Each file is opened once, in a task, and no folder is listed.

    Plain PNG files, and masks of 16 bits, are decoded from these bytes. Only where other formats are among the files are these left to the scan,
    and in stores that Arrow doesn't know all are.
    """
    at = discovery.qualified(spark, root)
    wanted = paths.where(F.startswith(F.col("path"), F.lit(f"{at}/")))
    if not _known_store(root):
        found = facts(spark, root, side, components, expected=wanted)
        return written(found.join(wanted.select("path").distinct(), "path", "left_semi"), "facts")
    schema = f"path string, kind string, length long, digest string, {FACTS.partition(', ')[2]}, left boolean"
    fields, blank = _fields(schema), (None,) * FACTS.count(", ")

    def row(path: str, kind: str, content: bytes) -> tuple:
        own = png.is_plain(content) or kind == "mask" and png.depth(content) == 16
        pixels = png.decoded(content) if own else None
        good = pixels is not None and pixels.size > 0
        found = _facts(path, kind == "mask", pixels, side, components)[1:] if good else blank
        return path, kind, len(content), hashlib.md5(content).hexdigest(), *found, not good and content.startswith(STARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            out = []
            for path, kind in zip(batch.column("path").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                file = base.rstrip("/") + path[len(at) :]
                try:
                    with store.open_input_file(file) as f:
                        out.append(row(path, kind, f.read()))
                except OSError:
                    if store.get_file_info(file).type == fs.FileType.File:
                        raise
            yield _batch(out, fields)

    bounded_batches(spark)
    named = dealt(wanted, "path", FILES_EACH).select("path").distinct().withColumn("kind", discovery.file_class(F.col("path"), at)).where("kind IN ('image', 'mask')")
    opened = written(named.mapInArrow(run, schema), "opened")
    left = opened.where("left").select("path")
    if left.isEmpty():
        return opened.drop("left")
    scanned = facts(spark, root, side, components).join(left, "path", "left_semi")
    return written(opened.where("NOT left").drop("left").unionByName(scanned), "facts")


def planes(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, plane) of the images among ``paths`` (path): gray, 256 x 256, as 32-bit floats. Each is decoded once, whatever the number of its pairs."""
    wanted = paths.select("path").distinct()
    keys = wanted.select(file_key(F.col("path")).alias("key"))
    decoded = _images(spark, root)
    if keys.count() <= BROADCAST_PATHS:
        decoded = decoded.join(F.broadcast(keys), "key", "left_semi")
    found = _reduced(decoded, _of_struct, lambda row, pixels: (row["key"].as_py(), images.similarity_plane(pixels).astype(np.float32).tobytes()), PLANE)
    return wanted.join(found, file_key(F.col("path")) == F.col("key")).select("path", "plane")


def tensor_rows(spark: SparkSession, root: str, shape: tensors.Shape) -> DataFrame:
    """(key, tensor) of every image below ``root`` that decodes: normalised model inputs, made in the stage that reads the files."""
    decoded = _images(spark, root).where(~F.coalesce(_is_mask(spark, root), F.lit(False)))
    return _reduced(decoded, _of_struct, lambda row, pixels: (row["key"].as_py(), tensors.tensor_of(pixels, shape)), "key string, tensor array<float>")
